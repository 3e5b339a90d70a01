"""The preprocessing stages kept up to date: only what has changed is made again.

Rows are dealt into buckets by comment id, and each stage is a table in folders by bucket.  A
fingerprint of each bucket's input tells which buckets have changed; in these, new texts are processed
and added, and a bucket is written again only if some of its texts are gone.  Word counts
are held by bucket and add up.  The fingerprint of a bucket is written last, so an update that
fails is made good by the next one.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.operators import corpus
from murmur.sources.stages import stage


GATHERED = ("seen", "word_counts")
"""Tables of small rows: a shuffle costs little there and spares files."""


class IncrementalCorpus:
    """Processed rows, word counts and final tokens under ``root``, for inputs of one schema.

    Rows with equal values in all columns are one row.  Several rows may have the same id; an id
    may be null.  The number of buckets is part of the folder's name, like the input's columns.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, top_n: int = 50):
        self.spark, self.root, self.buckets, self.top_n = spark, root.rstrip("/"), buckets, top_n
        self.folder: str | None = None

    # --- tables in folders by bucket ------------------------------------------------------

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self, path):
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _complete(self, name: str) -> bool:
        path = self._path(f"{name}/_SUCCESS")
        return self._fs(path).exists(path)

    def _read(self, name: str) -> DataFrame | None:
        """A table in buckets, or None if it has never been written."""
        if not self._complete(f"{name}.schema"):
            return None
        schema = T.StructType.fromJson(json.loads(self.spark.read.text(f"{self.folder}/{name}.schema").first()[0]))
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def _read_small(self, name: str) -> list | None:
        """The rows of a table without buckets, which is overwritten as a whole, or None if it isn't complete."""
        return self.spark.read.parquet(f"{self.folder}/{name}").collect() if self._complete(name) else None

    def _put(self, rows: DataFrame, name: str, replaced: list[int]) -> None:
        """Set the buckets ``replaced`` of a table to their ``rows``; rows of other buckets are added to them.

        Texts are written where they are; only small rows are gathered by bucket before.
        """
        fs, folder = self._fs(self._path(name)), self._path(name)
        fs.mkdirs(folder)
        kept = [(p, f[0].getPath()) for p in (self._path(f"{name}/bucket={b}") for b in replaced)
                if fs.exists(p) and len(f := fs.listStatus(p))]
        if name in GATHERED:
            rows = rows.hint("rebalance", "bucket")
        mine = F.col("bucket").isin(replaced)
        parts = [("overwrite", rows.filter(mine)), ("append", rows.filter(~mine))] if replaced else [("append", rows)]
        for mode, some in parts:
            (some.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
                 .partitionBy("bucket").parquet(f"{self.folder}/{name}"))
        for path, file in kept:                                    # a bucket without rows has no folder
            if fs.exists(file):
                fs.delete(path, True)
        if not self._complete(f"{name}.schema"):
            self._put_small([(rows.schema.json(),)], "schema string", f"{name}.schema", "text")

    def _put_small(self, rows: list, schema: str, name: str, form: str = "parquet") -> None:
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").format(form).save(f"{self.folder}/{name}")

    # --- update ---------------------------------------------------------------------------

    def _keyed(self, raw: DataFrame) -> DataFrame:
        """(row_key, bucket, _row): a key of each row's whole content, equal rows once; ``_row`` is null if the row has been seen.

        One shuffle by the key does both, and only rows that haven't been seen are written with their content.
        """
        columns = [F.col(f"`{c}`") for c in raw.columns]
        key = F.sha2(F.to_json(F.struct(*columns)), 256)
        bucket = F.pmod(F.xxhash64("comment_id"), F.lit(self.buckets)).cast("int")
        rows = raw.select(key.alias("row_key"), bucket.alias("bucket"), F.struct(*columns).alias("_row")).dropDuplicates(["row_key"])
        seen = self._read("seen")
        if seen is None or self._read("processed") is None:
            return rows
        known = seen.select("row_key").distinct().withColumn("_known", F.lit(True))
        return rows.join(known, "row_key", "left").select("row_key", "bucket", F.when(F.col("_known").isNull(), F.col("_row")).alias("_row"))

    def update(self, raw: DataFrame) -> list[int]:
        """Bring the tables up to ``raw`` (comment_id, text, ...), and return the buckets that had changed."""
        self.folder = f"{self.root}/" + hashlib.sha256(repr((raw.dtypes, self.buckets)).encode()).hexdigest()[:16]
        rows = stage(self._keyed(raw), "keyed-input")
        said = {r["bucket"]: (r["n"], r["total"]) for r in rows.groupBy("bucket").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("row_key").cast("decimal(38,0)")).alias("total")).collect()}
        held = {r["bucket"]: (r["n"], r["total"]) for r in self._read_small("fingerprints") or []}
        changed = sorted(b for b in set(said) | set(held) if said.get(b) != held.get(b))
        if changed or not self._complete("stop"):
            self._refresh(rows.filter(F.col("bucket").isin(changed)), changed)
            spoken = [(b, n, total) for b, (n, total) in said.items()]
            self._put_small(spoken, "bucket int, n long, total decimal(38,0)", "fingerprints")
        return changed

    def _refresh(self, rows: DataFrame, changed: list[int]) -> None:
        in_changed = F.col("bucket").isin(changed)
        keys, processed = rows.select("row_key", "bucket"), self._read("processed")
        made, replaced = corpus.prepare(rows.filter("_row is not null").select("_row.*", "row_key", "bucket")), []
        if processed is not None:
            # Stored rows that aren't to stay are gone from the input, or a failed update had stored them.  Their
            # buckets are written again, with the rows that stay; to the others the new rows are added.
            stay = rows.filter("_row is null").select("bucket", "row_key")
            stored = processed.filter(in_changed)
            gone = stored.select("bucket", "row_key").join(stay, ["bucket", "row_key"], "left_anti")
            replaced = sorted(r["bucket"] for r in gone.select("bucket").distinct().collect())       # a number for each bucket at most
            if replaced:
                stored = stored.filter(F.col("bucket").isin(replaced)).join(stay, ["bucket", "row_key"], "left_semi")
                made = stage(made.unionByName(stored), "new-processed")                  # it is read from the same table
        self._put(made, "processed", replaced)
        self._put(keys, "seen", changed)
        counts = self._read("processed").filter(in_changed).select("bucket", F.explode_outer("lemmas").alias("word")).filter(F.col("word").isNotNull())
        self._put(counts.groupBy("bucket", "word").agg(F.count(F.lit(1)).alias("frequency")), "word_counts", changed)

        stop = corpus.stopword_list(self.word_frequency(), self.top_n)
        before = self._read_small("stop")
        if before is not None and sorted(r[0] for r in before) == sorted(stop):
            self._put(corpus.with_final_tokens(self._read("processed").filter(in_changed), stop), "final", changed)
        else:                                                       # other stopwords: the tokens of all rows, from their lemmas
            self._put(corpus.with_final_tokens(self._read("processed"), stop), "final", list(range(self.buckets)))
            self._put_small([(w,) for w in stop], "word string", "stop")

    # --- results --------------------------------------------------------------------------

    def word_frequency(self) -> DataFrame:
        """(word, frequency), the buckets' counts added up."""
        return self._read("word_counts").groupBy("word").agg(F.sum("frequency").alias("frequency"))

    @property
    def processed(self) -> DataFrame:
        return self._read("processed").drop("bucket", "row_key")

    @property
    def final(self) -> DataFrame:
        """The rows with their final tokens, as ``corpus.preprocess`` gives them."""
        return self._read("final").drop("bucket", "row_key")
