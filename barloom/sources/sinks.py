"""Writers: bars with their indicators as CSV, feature tables, and nested reports."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.plans.ordered import in_order


def write_csv(df: DataFrame, path: str, keys: tuple[str, ...] = ("symbol",), order: str = "dt", sep: str = ",", counter: bool = True, rounding: int | None = None, compression: str | None = None) -> None:
    """Rows in order within every key, nulls as nothing; `counter` puts a row number of the key in front."""
    from pyspark.sql import Window

    if rounding is not None:
        df = df.select(*(F.round(c, rounding).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
    if counter:
        df = df.select(F.row_number().over(Window.partitionBy(*keys).orderBy(order)).alias("Id"), "*")
    else:
        df = df.repartition(*keys).sortWithinPartitions(*keys, order)
    df.write.csv(path, header=True, sep=sep, nullValue="", compression=compression or "none", mode="overwrite")


def to_text(df: DataFrame, sep: str = ",", most: int = 100_000) -> str:
    """A small result as CSV text in memory: at most `most` rows, more are an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; write them with write_csv")
    fit = lambda v: "" if v is None else str(v)
    return "\n".join([sep.join(df.columns), *(sep.join(map(fit, r)) for r in rows)]) + "\n"


def write_features(df: DataFrame, path: str, summary: str | None = None, partition_by: list[str] | None = None) -> None:
    """A feature table as Parquet (or gzipped CSV by its name), and a JSON summary of its rows and columns."""
    if path.endswith(".csv.gz"):
        df.write.csv(path, header=True, compression="gzip", mode="overwrite")
    else:
        df.write.parquet(path, mode="overwrite", partitionBy=partition_by)
    if summary:
        made = df.agg(F.count("*").alias("rows"), F.min("dt").alias("first"), F.max("dt").alias("last"))
        made.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(summary)


def report(results: dict, indent: int = 2, rounding: int | None = None, level: int = 0, most: int = 10_000) -> str:
    """A nested report as indented text; of a frame, which should be a small one, the first `most` rows are shown."""
    out = []
    for k, v in results.items():
        if isinstance(v, DataFrame):
            v = {str(i): json.loads(r) for i, r in enumerate(v.toJSON().take(most))}
        if isinstance(v, dict):
            out += [f"{' ' * indent * level}- {k}:", report(v, indent, rounding, level + 1, most)]
        else:
            out.append(f"{' ' * indent * level}- {k}: {round(v, rounding) if rounding is not None and isinstance(v, float) else v}")
    return "\n".join(x for x in out if x)


def write_binary(df: DataFrame, folder: str, intraday: bool = False) -> DataFrame:
    """Bars as binary records (see readers.binary_bars), one file for each symbol under its own folder; returns symbol, file, records.

    Files are written by the tasks into a folder that all share, under a name of their own, and then moved into place. Volume and
    interest are whole numbers, prices have single precision; a null is 0.
    """
    form = "<IIffffII" if intraday else "<IffffII"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import struct
        import uuid

        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(folder)
        now = out = tmp = None
        n = 0

        def close() -> pa.RecordBatch:
            out.close()
            store.move(tmp, f"{top}/symbol={now}/bars.bin")
            return pa.RecordBatch.from_pydict({"symbol": [now], "file": [f"{folder}/symbol={now}/bars.bin"], "records": [n]})

        for batch in batches:
            for r in batch.to_pylist():
                if r["symbol"] != now:
                    if out:
                        yield close()
                    now, n, tmp = r["symbol"], 0, f"{top}/.{uuid.uuid4().hex}"
                    store.create_dir(f"{top}/symbol={now}", recursive=True)
                    out = store.open_output_stream(tmp)
                dt = r["dt"]
                day = dt.year * 500 + dt.month * 32 + dt.day
                clock = (dt.hour * 60 + dt.minute,) if intraday else ()
                out.write(struct.pack(form, day, *clock, *(r[c] or 0.0 for c in ("open", "high", "low", "close")), int(r["volume"] or 0), int(r["openinterest"] or 0)))
                n += 1
        if out:
            yield close()

    own = df.select("symbol", "dt", "open", "high", "low", "close", "volume", "openinterest")
    return in_order(own, ["symbol"], "dt").mapInArrow(run, "symbol string, file string, records long")
