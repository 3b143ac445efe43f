"""Every operator against brute force on small made-up tables, with nulls, empty and long texts, ties and clashing names."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from barloom.llm import byte_bpe, chat, decontaminate, graph, licences, near_dedup, quality, substring_dedup, token_counts, token_files, toxicity
from barloom.llm.common import own_folder
from barloom.llm.queries import pattern, vocabulary

PLAIN, LETTERS = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, words string, kept string, `a.b` int"
ODD = [None, "", "   ", "\n\t", "one", "One  two\nTHREE", "\x00 null\x00 bytes", "é" * 300, "x" * 2000, "日本 語 テスト", "a▁b c", "don't 's  we'll\r\n\r\n x", " lead", "tail ", "<|endoftext|> in text"]


def words(text):
    return PLAIN.findall(text or "")


def frame(spark, docs, parts=3):
    return spark.createDataFrame([(d, t, "w", "k", 1) for d, t in docs], SCHEMA).repartition(parts)


@pytest.fixture(scope="module")
def docs():
    r = random.Random(3)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6))) for _ in range(400)]
    out = [" ".join(r.choice(vocab) for _ in range(r.randint(1, 120))) for _ in range(60)]
    passage = " ".join(r.choice(vocab) for _ in range(50))
    out += [f"{x} {passage} {x[::-1]}" for x in out[:12]] + out[:4]
    base = [f"w{k}" for k in range(150)]
    for _ in range(60):
        w = list(base)
        for _ in range(r.randint(0, 14)):
            w[r.randrange(150)] = f"x{r.randint(0, 10**6)}"
        out.append(" ".join(w))
    out += ["loop loop loop " * 40, passage, *ODD]
    return [(i * 7 % 1000, t) for i, t in enumerate(out)]


def test_near_duplicates(spark, docs):
    got = {r.doc_id: r for r in near_dedup.near_duplicates(frame(spark, [*docs, (None, "some text"), (None, None)])).collect() if r.doc_id is not None}
    shingle = lambda w: frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    sets = {d: shingle([re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words(t)]) for d, t in docs}
    root = {d: d for d in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations([d for d in sets if sets[d]], 2):
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            a, b = sorted((top(a), top(b)))
            root[b] = a
    assert {d: (r.n_shingles, r.component_id, r.kept) for d, r in got.items()} == {d: (len(s), top(d), top(d) == d) for d, s in sets.items()}
    kept = near_dedup.keep_one_of_each(frame(spark, [*docs, docs[0], (None, "some text")]))
    assert kept.columns == ["doc_id", "text", "words", "kept", "a.b"]
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(d for d in sets if top(d) == d)


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 1), (7, 7), (8, 9), (None, 2)], "a long, b long")
    assert sorted((r.node, r.component) for r in graph.components(edges).collect()) == [(1, 1), (3, 1), (4, 1), (5, 1), (8, 8), (9, 8)]
    chain = spark.createDataFrame([(k, k + 1) for k in range(60)], "a long, b long")
    assert {r.component for r in graph.components(chain).collect()} == {0}


@pytest.mark.parametrize("width", [3, 35])
def test_repeated_passages(spark, docs, width):
    rows = [*docs, docs[5], (None, docs[6][1])]
    got = substring_dedup.remove_repeated_passages(frame(spark, rows), width=width, into="kept").collect()
    count = collections.Counter(tuple(w[k : k + width]) for _, t in rows for w in [words(t)] for k in range(len(w) - width + 1))

    def brute(t):
        w = words(t)
        gone = set()
        for k in range(len(w) - width + 1):
            if count[tuple(w[k : k + width])] > 1:
                gone |= set(range(k, k + width))
        return len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)

    assert sorted((str(r.doc_id), str(r.text), *tuple(r.kept)[:3]) for r in got) == sorted((str(d), str(t), *brute(t)) for d, t in rows)
    assert all(sum(s.end - s.start for s in r.kept.spans) == r.kept.n_removed for r in got)
    assert got[0].asDict().keys() == {"doc_id", "text", "words", "a.b", "kept"}


def test_quality(spark, docs):
    junk = [(2000 + k, " ".join(f"{random.Random(k * 50 + j).choice(['the', 'of', 'was'])}***" for j in range(40))) for k in range(20)]
    rows = [*docs, *junk, docs[3], (None, "a b c d e f g h i j k l")]
    trusted = spark.createDataFrame([(d,) for d, _ in docs[:60]] + [(None,)], "good long")
    got = quality.quality_scores(frame(spark, rows), trusted, into="kept")
    assert got.columns == ["doc_id", "text", "words", "a.b", "kept"]
    out = got.collect()
    assert len(out) == len(rows)
    for r in out:
        t, w = r.text or "", words(r.text)
        c = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        twice = {p for k in range(len(w) - 4) if c[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
        lines = [x for x in t.split("\n") if words(x)]
        failed = len(w) < 10 or 100 * len(twice) > 20 * len(w)
        assert tuple(r.kept)[:6] == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(twice), failed)
        assert not (r.kept.kept and failed) and (r.kept.llr is None) == (not w)
    score = {r.doc_id: r.kept.llr for r in out}
    assert max(score[d] for d, _ in junk) < min(score[d] for d, t in docs[:60] if len(words(t)) > 20)
    assert quality.drop_low_quality(frame(spark, rows), trusted).count() == sum(r.kept.kept for r in out)
    assert quality.quality_scores(frame(spark, []), trusted).count() == 0


def test_decontamination(spark, docs):
    items = [(1, docs[2][1]), (2, " ".join(words(docs[70][1])[20:60])), (3, "one two three"), (4, None), (5, ""), (None, docs[9][1]), (7, docs[2][1])]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, words string")
    lower = lambda t: LETTERS.findall((t or "").encode().lower())
    windows = collections.defaultdict(set)
    for i, t in items:
        w = lower(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(i)
    rows = [*docs, docs[2], (None, docs[2][1])]
    for most in (100_000, 0):
        got = decontaminate.benchmark_hits(frame(spark, rows), bench, broadcast_windows=most).collect()
        want = []
        for d, t in rows:
            w, hit, found = lower(t), set(), set()
            for n in {len(k) for k in windows}:
                for k in range(len(w) - n + 1):
                    if tuple(w[k : k + n]) in windows:
                        hit |= set(range(k, k + n))
                        found |= windows[tuple(w[k : k + n])] - {None}
            want.append((str(d), len(w), len(hit), tuple(sorted(map(str, found)))))
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, tuple(r["items"])) for r in got) == sorted(want)
    clean = decontaminate.drop_contaminated(frame(spark, rows), bench)
    assert clean.columns == ["doc_id", "text", "words", "kept", "a.b"] and clean.count() == sum(n == 0 for _, _, n, _ in want)
    assert decontaminate.benchmark_hits(frame(spark, []), bench).count() == 0
    assert decontaminate.drop_contaminated(frame(spark, rows), bench.limit(0)).count() == len(rows)


def test_licences(spark):
    rows = [(1, "x\nLicensed under the Apache License, Version 2.0.\ny"), (2, "all rights reserved. ALL RIGHTS RESERVED"), (3, "This work is licensed under the GNU General Public License, version 3."), (4, "Licensed under CC BY-NC 4.0."), (5, "Released under the MIT License."), (6, "the license of a version"), (7, None), (8, ""), (2, "all rights reserved. ALL RIGHTS RESERVED"), (None, "cc by")]
    got = licences.licence_labels(frame(spark, rows)).collect()
    by = {(r.doc_id, r.n_words): r for r in got}
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in by.values() if r.doc_id} == {
        1: (0, None, None, "", "apache-2.0"), 2: (2, 0, 3, "reserved", "reserved"), 3: (1, 7, 7, "gpl", "gpl,gpl-3.0"), 4: (1, 2, 2, "cc-by", "cc-by,cc-by-nc-4.0"), 5: (0, None, None, "", "mit"), 6: (0, None, None, "", ""), 7: (0, None, None, "", ""), 8: (0, None, None, "", ""),
    }
    assert all(0 <= r.score <= 1 for r in got) and by[1, 10].score > 0.9 and by[6, 5].score == 0
    assert licences.licence_labels(frame(spark, [])).count() == 0


def test_chat(spark):
    turns = [(1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "bot", "b"), (3, 5, "user", "a"), (3, 6, "bot", "b"), (3, 9, "user", "c"), (4, 0, "user", "a"), (4, 1, "bot", "x"), (5, 0, "user", "a"), (5, 1, "bot", "b"), (5, 2, "user", "c"), (6, None, None, None), (6, 1, "user", None), (7, 0, "user", None), (None, 0, "user", "z"), (8, 0, "user", ""), (9, 0, None, None)]
    df = spark.createDataFrame([(*t, "n") for t in turns], "conv_id long, turn long, role string, text string, place string").repartition(4)
    for run in (1, 1024):
        chat.RUN = run
        got = {(r.conv_id, r.part): (r.n_turns, r.text) for r in chat.collapse_conversations(df, part_turns=2).collect()}
        assert {k[0] for k in got} == {3, 4, 6, 7, 8} and got[3, 0] == (2, "<|user|>\na\n<|bot|>\nb\n") and got[3, 1] == (1, "<|user|>\nc\n") and got[6, 0] == (2, "<||>\n\n<|user|>\n\n")
    assert chat.collapse_conversations(df.limit(0)).count() == 0


def test_byte_bpe(spark, docs):
    import tiktoken

    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    encoder = tiktoken.Encoding("own", pat_str=pattern(), mergeable_ranks=byte_bpe.load(path, pattern()).ranks, special_tokens={})
    out = byte_bpe.encode_and_decode(frame(spark, docs), path, pattern(), into="kept").collect()
    for r in out:
        assert r.kept.ids == encoder.encode_ordinary(r.text or "") and r.kept.decoded == (r.text or "").encode()
    again = byte_bpe.decode_ids(spark.createDataFrame([(1, [r.kept.ids for r in out if r.text == "One  two\nTHREE"][0]), (2, []), (3, None)], "n int, ids array<int>"), path, pattern()).orderBy("n").collect()
    assert [bytes(r.decoded) for r in again] == [b"One  two\nTHREE", b"", b""]


def test_token_files(spark, docs):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    files = token_files.write_tokens(frame(spark, docs), own_folder(spark, "t"), vocabulary("byte_bpe_50k.json"), 2)
    got = {r.doc_id: r for r in token_files.read_tokens(files).collect()}
    at = 0
    for d, t in sorted(docs, key=lambda x: x[0]):
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 2]
        r = got[d]
        assert (r.start, r.n_tokens) == (at, len(ids)) and zlib.crc32(r.ids) == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert token_files.write_tokens(frame(spark, []), own_folder(spark, "e"), vocabulary("byte_bpe_50k.json"), 2).count() == 0


@pytest.mark.parametrize("top", [1, 2, 5, 300, 50_000, 100_000])
def test_wavelet_matrix(top):
    r = np.random.default_rng(top)
    ids = r.integers(0, top, 5000).astype(np.uint32)
    old, token_files.BLOCK = token_files.BLOCK, 64
    try:
        s = token_files.Shard(token_files.build(ids, [None, 7], np.array([100, 5000])))
        assert s.docs == [None, 7] and list(s.ends) == [100, 5000] and (s.ids() == ids).all()
        for i in (0, 1, 511, 512, 513, 4999):
            assert s.access(i) == ids[i]
        for t in {int(ids[0]), int(ids[77]), top + 1}:
            places = np.flatnonzero(ids == t)
            assert s.count(t) == len(places) and s.rank(t, 1000) == (places < 1000).sum()
            assert [s.select(t, k) for k in range(min(5, len(places)))] == list(places[:5]) and s.select(t, len(places)) == -1
    finally:
        token_files.BLOCK = old


def test_token_counts(docs):
    from tokenizers import Tokenizer, models

    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    exact = Tokenizer(models.Unigram([(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())], 0, True))
    texts = [t for _, t in docs]
    mark = token_counts.MARK
    want = [len(exact.encode(mark + t.replace(" ", mark)).ids) if t else 0 for t in texts]
    assert list(token_counts.load(path).counts(pa.array(texts))) == want
    whole = token_counts.UnigramCounter([("ab", -1.0), ("a", -1.0), ("b", -1.0), ("▁", -0.5)], byte_fallback=False)
    assert not whole.cut and list(whole.counts(pa.array(["ab ab", "azz", None]))) == [4, 3, 0]


def test_token_count_frame(spark, docs):
    out = token_counts.count_tokens(frame(spark, docs), vocabulary("piece_bpe_32k.model"), into="kept")
    assert out.columns == ["doc_id", "text", "words", "a.b", "kept"] and out.where("text IS NULL OR text = ''").agg({"kept": "sum"}).first()[0] == 0


def test_toxicity(spark):
    r = random.Random(1)
    vocab = ["".join(r.choice(("ba", "do", "ki", "lu", "ne", "so")) for _ in range(r.randint(1, 4))) for _ in range(300)]
    docs, labels = [], []
    for d in range(600):
        w = [r.choice(vocab) for _ in range(60)]
        bad = d % 3 == 0
        if bad:
            w[::8] = [f"grix{r.choice('aeiou')}{r.choice('mnp')}" for _ in w[::8]]
        docs.append((d, " ".join(w)))
        labels.append((d, 1, int(bad), "x"))
    table = spark.createDataFrame([*labels, (None, 1, 1, "x"), (5, 1, None, "x")], "doc_id long, quality int, toxic int, score string")
    rows = [*docs, (9000, None), (9001, ""), (None, "ba do"), docs[0]]
    got = toxicity.toxicity_scores(frame(spark, rows), table, into="kept")
    assert got.columns == ["doc_id", "text", "words", "a.b", "kept"]
    out = got.collect()
    held = [x for x in out if x.kept.held_out and x.doc_id < 9000]
    assert len(out) == len(rows) and all(x.kept.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in out if x.doc_id is not None)
    assert np.mean([x.kept.predicted == (x.doc_id % 3 == 0) for x in held]) > 0.97 and all(0 <= x.kept.score <= 1 for x in out)
    flipped = spark.createDataFrame([(d, q, 1 - t if zlib.crc32(str(d).encode()) % 5 == 0 else t, s) for d, q, t, s in labels] + [(5, 1, None, "x")], table.schema)
    same = {x.doc_id: x.kept.score for x in toxicity.toxicity_scores(frame(spark, rows), flipped, into="kept").collect()}
    assert all(abs(same[x.doc_id] - x.kept.score) < 1e-9 for x in out if x.doc_id in same)
    none = toxicity.toxicity_scores(frame(spark, docs[:5]), table.limit(0), into="kept").collect()
    assert all(x.kept.score == 0 and x.kept.predicted == 0 for x in none)


def test_pipeline(spark, small, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, left, small).write.parquet(f"file://{tmp_path}/{name}")
        left = spark.read.parquet(f"file://{tmp_path}/{name}")
        assert left.columns == docs.columns and left.where("n_chars <> char_length(text)").count() == 0
    out = corpus_pipeline.STAGES[-1][1](spark, left, small)
    assert out.count() == left.count() and out.where("NOT round_trip").count() == 0
