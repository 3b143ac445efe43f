"""Cases in which an operator once did less than its whole job."""

import hashlib
import random
import zlib

import numpy as np
import pytest

import brute
import corpus_pipeline
from barloom.llm import byte_bpe, chat, decontaminate, licences, near_dedup, quality, substring_dedup, token_counts, token_files, toxicity
from barloom.llm.common import own_folder
from barloom.llm.queries import pattern, vocabulary

DOCS = "doc_id long, text string"


def table(spark, rows, parts=3):
    return spark.createDataFrame(list(rows), DOCS).repartition(parts)


def toxic_table(spark, n=1200, seed=5):
    """Every third document holds two of 60 marking words, which are made of the same syllables as all others."""
    r = random.Random(seed)
    syllables = ["ba", "do", "ki", "lu", "ne", "so", "ra", "ti"]
    make = lambda: "".join(r.choice(syllables) for _ in range(4))
    marks = list({make() for _ in range(60)})
    vocab = [w for w in {make() for _ in range(900)} if w not in marks]
    docs, labels = [], []
    for d in range(n):
        w = [r.choice(vocab) for _ in range(80)]
        if d % 3 == 0:
            w[10], w[50] = r.choice(marks), r.choice(marks)
        docs.append((d, " ".join(w)))
        labels.append((d, int(d % 3 == 0)))
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxic_words_of_common_syllables(spark):
    docs, labels = toxic_table(spark)
    held = toxicity.toxicity_scores(docs, labels).where("toxicity.held_out").select("doc_id", "toxicity.predicted").collect()
    assert sum(r.predicted for r in held if r.doc_id % 3 == 0) >= 0.9 * sum(r.doc_id % 3 == 0 for r in held)
    assert sum(r.predicted for r in held if r.doc_id % 3) <= 0.02 * sum(r.doc_id % 3 > 0 for r in held)


def test_toxicity_counts_all_labels(spark, monkeypatch):
    docs, labels = toxic_table(spark)
    score = lambda **options: {r.doc_id: (r.toxicity.score, r.toxicity.held_out) for r in toxicity.toxicity_scores(docs, labels, **options).collect()}
    few = {d: s for d, (s, held) in score(max_docs=10).items() if held}  # the curve is poor, but the order of documents isn't
    toxic, ordinary = ([s for d, s in few.items() if (d % 3 == 0) == bad] for bad in (True, False))
    assert sum(s > max(ordinary) for s in toxic) >= 0.8 * len(toxic)
    whole = score()
    monkeypatch.setattr(toxicity, "BROADCAST_LABELS", 0)
    joined = score(broadcast_words=0)
    assert whole.keys() == joined.keys() and all(abs(whole[d][0] - joined[d][0]) < 1e-6 for d in whole)


def near(spark, rows, **options):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(table(spark, rows), **options).collect()}


def letters(r, n):
    return ["".join(r.choice("abcdefghijkl") for _ in range(8)) for _ in range(n)]


def test_pairs_at_the_threshold(spark):
    """Families at and just under 75 %: bases of few shingles, of which others lack a quarter, or one more or less; and 400
    documents of which each is at exactly 3/4 with the last one and with no other: one component."""
    r, texts = random.Random(5), []
    for union in (4, 8, 12, 20, 60):
        for _ in range(12):
            base = letters(r, union + 4)
            less = union - -(-3 * union // 4)
            for cut in (less, less + 1, max(0, less - 1)):
                texts += [" ".join(base), " ".join(base[cut:]), " ".join(base[: len(base) - cut]), " ".join([*letters(r, cut), *base])]
    r.shuffle(texts)
    rows = [(k, f"a1 a2 a3 a4 a5 a6 a7 u{k}") for k in range(400)] + [(400, "a1 a2 a3 a4 a5 a6 a7")] + [(500 + k, t) for k, t in enumerate(texts)]
    got = near(spark, rows)
    assert got == brute.near_duplicates(rows) and {got[k][1] for k in range(401)} == {0}


def test_family_of_noisy_copies(spark, monkeypatch):
    """Copies with 0 to 20 changed words of 120: many components, links that no star has; also in blocks of a few documents."""
    r = random.Random(7)
    base, rows = letters(r, 120), []
    for k in range(150):
        w = list(base)
        for _ in range(r.randint(0, 20)):
            w[r.randrange(120)] = r.choice(base[:9]) if r.random() < 0.5 else f"x{r.randint(0, 30)}"
        rows.append((k * 3 % 151, " ".join(w)))
    want = brute.near_duplicates(rows)
    assert near(spark, rows) == want
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 2000)
    monkeypatch.setattr(near_dedup, "BROADCAST_FAMILIES", 0)
    assert near(spark, rows) == want


def test_one_id_of_two_texts(spark):
    r = random.Random(1)
    a, b, c = (letters(r, 30) for _ in range(3))
    rows = [(5, " ".join(a)), (5, " ".join(b)), (7, " ".join([*a, "x"])), (8, " ".join(["x", *b])), (9, " ".join(c)), (9, " ".join(c)), (3, None)]
    got = near_dedup.near_duplicates(table(spark, rows)).collect()
    assert sorted((x.doc_id, x.component_id) for x in got) == [(3, 3), (5, 5), (5, 5), (7, 5), (8, 5), (9, 9), (9, 9)]


def thue_morse(n):
    word = "".join("ab"[k.bit_count() & 1] for k in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("size", [1024, 2048, 4096])
def test_words_with_equal_polynomials(spark, size):
    import tiktoken
    from tokenizers import Tokenizer

    one, two = thue_morse(size)
    rest = " ".join(f"w{k}" for k in range(34))
    rows = [(1, f"{one} {rest}"), (2, f"{two} {rest}"), (3, f"x {one}"), (4, f"x {two}")]
    got = {r.doc_id: r.passages.n_removed for r in substring_dedup.remove_repeated_passages(table(spark, rows, 1)).collect()}
    assert got == dict.fromkeys(range(1, 5), 0)
    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    encoder = tiktoken.Encoding("own", pat_str=pattern(), mergeable_ranks=byte_bpe.load(path, pattern()).ranks, special_tokens={})
    for r in byte_bpe.encode_and_decode(table(spark, rows, 1), path, pattern()).collect():
        assert r.bpe.ids == encoder.encode_ordinary(r.text)
    model = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    files = token_files.write_tokens(table(spark, rows, 1), own_folder(spark, "tm"), vocabulary("byte_bpe_50k.json"), 2)
    for r in token_files.read_tokens(files).collect():
        assert r.ids == np.array([*model.encode(dict(rows)[r.doc_id], add_special_tokens=False).ids, 2], "<u4").tobytes()
    assert near(spark, [(1, one), (2, two)]) == {1: (1, 1), 2: (1, 2)}


def test_chunks_with_equal_fingerprints(monkeypatch):
    """Even if fingerprints say nothing at all, ids are right."""
    import tiktoken

    from barloom.llm import chunk_table

    monkeypatch.setattr(chunk_table, "fingerprints", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    model = byte_bpe.RankedBPE(path, pattern())
    encoder = tiktoken.Encoding("own", pat_str=pattern(), mergeable_ranks=model.ranks, special_tokens={})
    import pyarrow as pa

    texts = ["one two six", "two one ten", "", "six", None, "a b c one", "x\ny"]
    assert [list(x) for x in model.encode(pa.array(texts))] == [encoder.encode_ordinary(t or "") for t in texts]


MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"


def test_notice_with_a_repeated_word(spark):
    other = [(k, f"plain words number {k}") for k in range(3, 13)]
    for rows in ([(1, MPL), (2, MPL.replace("the ", "")), (3, MPL.replace("the ", "")), *((k + 1, t) for k, t in other)], [(1, MPL), (2, MPL.replace("the ", "")), (3, MPL.replace("the ", ""))]):
        got = {r.doc_id: r for r in licences.licence_labels(table(spark, rows)).collect()}
        assert len(got) == len(rows) == licences.licence_labels(table(spark, rows)).count()
        assert got[1].labels == "mpl-2.0" and got[1].score > 0.9 and got[2].labels == ""


def test_titles_bodies_and_beginnings(spark):
    rows = [(1, "MIT License\n\nCopyright"), (2, "Apache License\nVersion 2.0, January 2004"), (3, "GNU General Public License, version 3"), (4, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"), (5, MPL.removeprefix("This ")), (6, "license"), (7, None)]
    got = {r.doc_id: r.labels for r in licences.licence_labels(table(spark, rows)).collect()}
    assert got == {1: "mit", 2: "apache-2.0", 3: "gpl,gpl-3.0", 4: "mit", 5: "mpl-2.0", 6: "", 7: ""}


def test_ratio_and_verdicts(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(None, docs[0][1]), (docs[1][0], "a b c d e f g h i j k"), (10**6, None), (10**6 + 1, "")]
    good = {r.doc_id for r in spark.read.parquet(f"{small}/labels.parquet").where("quality = 1 and toxic = 0").collect()}
    want = sorted(((str(d), str(t), *v) for (d, t), v in zip(docs, brute.quality(docs, good), strict=True)), key=str)
    trusted = spark.createDataFrame([(d,) for d in good], "good long")
    for most in (quality.BROADCAST_IDS, 0):
        old, quality.BROADCAST_IDS = quality.BROADCAST_IDS, most
        try:
            got = quality.quality_scores(table(spark, docs), trusted).collect()
        finally:
            quality.BROADCAST_IDS = old
        got = sorted(((str(r.doc_id), str(r.text), r.quality.base_failed, r.quality.llr, r.quality.kept) for r in got), key=str)
        assert [x[:3] + x[4:] for x in got] == [x[:3] + x[4:] for x in want]
        assert all((a[3] is None) == (b[3] is None) and (a[3] is None or abs(a[3] - b[3]) < 1e-9) for a, b in zip(got, want, strict=True))


def test_stages_against_brute_force(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    good = {r.doc_id for r in spark.read.parquet(f"{small}/labels.parquet").where("quality = 1 and toxic = 0").collect()}
    items = [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    rows = {r.doc_id: r.text for r in docs.collect()}
    dropped = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, small).write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        before, rows = list(rows.items()), {r.doc_id: r.text for r in docs.collect()}
        if name == "quality_rules":
            want = {d: t for (d, t), v in zip(before, brute.quality(before, good), strict=True) if v[2]}
        elif name == "near_duplicates":
            found = brute.near_duplicates(before)
            want = {d: t for d, t in before if found[d][1] == d}
        elif name == "repeated_passages":
            want = {d: kept if n else t for (d, t), (_, n, kept) in zip(before, brute.repeated_passages([t for _, t in before]), strict=True)}
        else:
            want = {d: t for (d, t), bad in zip(before, brute.leaks([t for _, t in before], items), strict=True) if not bad}
        assert rows == want
        dropped.append(len(before) - len(rows))
    assert dropped[0] > 0 and dropped[1] > 0


def test_texts_of_more_than_a_block(spark):
    """Texts of over 1 MB, and many short ones beside them, through every operator."""
    from tokenizers import Tokenizer, models

    import sentencepiece
    import tiktoken

    r = random.Random(4)
    vocab = letters(r, 3000)
    big = " ".join(r.choice(vocab) for _ in range(150_000))
    passage = " ".join(letters(r, 40))
    rows = [(1, big), (2, f"{big} {passage} MIT License"), (3, passage), (4, big[: 1 << 20]), *((k, " ".join(r.choice(vocab) for _ in range(20))) for k in range(5, 60))]
    assert len(big) > 1 << 20
    df = table(spark, rows, 2)
    assert near(spark, rows) == brute.near_duplicates(rows)
    got = substring_dedup.remove_repeated_passages(df).collect()
    assert {x.doc_id: (x.passages.n_words, x.passages.n_removed, x.passages.kept) for x in got} == dict(zip([d for d, _ in rows], brute.repeated_passages([t for _, t in rows]), strict=True))
    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    encoder = tiktoken.Encoding("own", pat_str=pattern(), mergeable_ranks=byte_bpe.load(path, pattern()).ranks, special_tokens={})
    assert all(x.bpe.ids == encoder.encode_ordinary(x.text) and x.bpe.decoded == x.text.encode() for x in byte_bpe.encode_and_decode(df, path, pattern()).collect())
    model = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    files = token_files.write_tokens(df, own_folder(spark, "big"), vocabulary("byte_bpe_50k.json"), 2)
    text = dict(rows)
    assert all(zlib.crc32(x.ids) == zlib.crc32(np.array([*model.encode(text[x.doc_id], add_special_tokens=False).ids, 2], "<u4").tobytes()) for x in token_files.read_tokens(files).collect())
    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    unigram = Tokenizer(models.Unigram([(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())], 0, True))
    mark = token_counts.MARK
    counted = {x.doc_id: x.n_tokens for x in token_counts.count_tokens(df, vocabulary("piece_bpe_32k.model")).collect()}
    assert all(counted[d] == len(unigram.encode(mark + t.replace(" ", mark)).ids) for d, t in rows if d > 2)
    item = spark.createDataFrame([(1, passage)], "item_id long, text string")
    hits = {x.doc_id: (x.n_words, x.n_hit) for x in decontaminate.benchmark_hits(df, item).collect()}
    assert hits[2] == (150_042, 40) and hits[3] == (40, 40) and hits[1] == (150_000, 0)
    assert {x.doc_id: x.labels for x in licences.licence_labels(df).collect() if x.labels} == {2: "mit"}
    assert toxicity.toxicity_scores(df, spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")).count() == len(rows)
    turns = spark.createDataFrame([(1, 0, "user", big), (1, 1, "bot", "b"), (2, 0, "user", big)], "conv_id long, turn long, role string, text string")
    out = chat.collapse_conversations(turns).collect()
    assert [(x.conv_id, x.n_turns, hashlib.md5(x.text.encode()).hexdigest()) for x in out] == [(1, 2, hashlib.md5(f"<|user|>\n{big}\n<|bot|>\nb\n".encode()).hexdigest())]


def test_rows_that_come_twice_and_null_ids(spark):
    rows = [(1, "one two three"), (1, "one two three"), (None, "one two three"), (None, None), (2, "one two three")]
    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    assert len({tuple(r.bpe.ids) for r in byte_bpe.encode_and_decode(table(spark, rows), path, pattern()).where("text is not null").collect()}) == 1
    assert sorted(r.n_tokens for r in token_counts.count_tokens(table(spark, rows), vocabulary("piece_bpe_32k.model")).collect())[0] == 0
    assert token_counts.count_tokens(table(spark, rows), vocabulary("piece_bpe_32k.model")).count() == 5
    out = token_files.read_tokens(token_files.write_tokens(table(spark, rows), own_folder(spark, "twice"), vocabulary("byte_bpe_50k.json"), 2)).orderBy("start").collect()
    assert [r.doc_id for r in out] == [None, None, 1, 1, 2] and out[0].n_tokens == 1 and [r.start for r in out] == list(np.cumsum([0, *(r.n_tokens for r in out[:-1])]))


def test_ties_of_rarity(spark):
    """All words of the windows are equally rare, and words stand several times in a window."""
    items = spark.createDataFrame([(1, "a b a b a b a b a b"), (2, "c c"), (3, "b a")], "item_id long, text string")
    rows = [(1, "a b a b a b a b a b a b"), (2, "c c c x b a"), (3, "c x c")]
    for most in (100_000, 0):
        got = {r.doc_id: (r.n_hit, list(r["items"])) for r in decontaminate.benchmark_hits(table(spark, rows), items, broadcast_windows=most, broadcast_words=most).collect()}
        assert got == {1: (12, ["1", "3"]), 2: (5, ["2", "3"]), 3: (0, [])}


def test_memo_of_words_with_equal_fingerprints():
    """A table that is told nothing by the first hash still gives each word its own value; slots are shared."""
    from barloom.llm.arrays import Memo, ends_of

    texts = [b"one", b"two", b"one", b"three", b"", b"a longer word than sixteen bytes", b"two"]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    memo = Memo(np.int64, 16)
    for prints in (np.full(len(texts), 1 << 63, np.uint64), np.arange(len(texts), dtype=np.uint64)):
        for _ in range(2):
            assert list(memo(prints, ends_of(data, starts, ends), lambda at: [len(texts[k]) for k in at])) == [len(t) for t in texts]


@pytest.mark.parametrize("size", [1024, 4096])
def test_counts_of_words_with_equal_polynomials(size):
    import pyarrow as pa
    import sentencepiece
    from tokenizers import Tokenizer, models

    path = vocabulary("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    unigram = Tokenizer(models.Unigram([(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())], 0, True))
    texts = [f"x {w}" for w in thue_morse(size)]
    assert list(token_counts.load(path).counts(pa.array(texts))) == [len(unigram.encode(token_counts.MARK + t.replace(" ", token_counts.MARK)).ids) for t in texts]
