"""Operator 4, token counts: rollups by source, language and tokenizer version, maintained by signed deltas.

A change is a signed row: an insert adds a document and its tokens, a delete takes them away, and a revision is a delete
of the old count and an insert of the new one. A batch of changes is reduced to one delta row per key and committed
under its batch id: the delta is written first, then a commit file that names it appears by a rename. A batch id that has
a commit file is never applied again, so a batch may be retried after any failure; a delta without commit file is ignored.
Totals are the sum of the committed deltas. compact() folds those into one and moves the batch ids into a table, so the driver
lists only what was committed since.

Defined cases: null source, language or text are keys and empty texts of their own; repeated rows count as often as they
occur; a key whose documents were all deleted disappears; an empty batch commits and changes nothing; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, delete, shared_dir, table
from .tokens import WordCachedTokenizer

KEY = ["source", "lang", "version"]
DELTA = "source string, lang string, version string, documents long, tokens long"
#: Documents with fewer words are taken out and put back by the query's last batches.
LEAST_WORDS = 5

_WORD = re.compile(r"\w+")


def signed(rows: DataFrame, version: str, tokens: str, sign: int) -> DataFrame:
    """Changes of one kind: rows with source, lang and a count column."""
    return rows.select("source", "lang", F.lit(version).alias("version"), F.lit(sign).cast("long").alias("sign"), F.col(tokens).cast("long").alias("tokens"))


class Rollup:
    """Totals in a shared folder: commits/<batch id> names the folder of the batch's delta."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._path(f"{self.folder}/commits"))

    def _commit_path(self, batch: str) -> str:
        if not re.fullmatch(r"[\w.-]+", batch):
            raise ValueError(f"not a batch id: {batch!r}")
        return f"{self.folder}/commits/{batch}"

    def _publish(self, batch: str, content: dict) -> bool:
        """The commit file appears whole or not at all, and only once."""
        temporary, final = self._path(f"{self.folder}/.{uuid.uuid4().hex}"), self._path(self._commit_path(batch))
        out = self.fs.create(temporary, False)
        out.write(json.dumps(content).encode())
        out.close()
        return not self.fs.exists(final) and self.fs.rename(temporary, final)

    def _commits(self) -> dict[str, dict]:
        found = {}
        for status in self.fs.listStatus(self._path(f"{self.folder}/commits")):
            name = status.getPath().getName()
            if not name.startswith("."):
                stream = self.fs.open(status.getPath())
                found[name] = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
                stream.close()
        return found

    def _covered(self, done: dict[str, dict], names: list[str]) -> set[str]:
        """Which of some batches a compaction has taken in."""
        tables = [c["covers"] for c in done.values() if "covers" in c]
        if not tables or not names:
            return set()
        return {r[0] for r in self.spark.read.schema("batch string").parquet(*tables).where(F.col("batch").isin(names)).distinct().collect()}

    def committed(self, batch: str) -> bool:
        done = self._commits()
        return batch in done or bool(self._covered(done, [batch]))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch of changes (source, lang, version, sign, tokens) once; False if it was applied before."""
        if self.committed(batch):
            return False
        delta = changes.groupBy(*KEY).agg(F.sum("sign").cast("long").alias("documents"), F.sum(F.col("sign") * F.col("tokens")).cast("long").alias("tokens"))
        return self._apply(batch, delta, {})

    def _apply(self, batch: str, delta: DataFrame, more: dict) -> bool:
        data = f"{self.folder}/deltas/{uuid.uuid4().hex}"
        delta.where("documents <> 0 OR tokens <> 0").write.parquet(data)
        if self._publish(batch, {"data": data, **more}):
            return True
        delete(self.spark, data)
        return False

    def totals(self) -> DataFrame:
        """source, lang, version, documents, tokens."""
        return self._sum(self._commits())

    def _sum(self, done: dict[str, dict]) -> DataFrame:
        covered = self._covered(done, list(done))
        paths = [c["data"] for b, c in done.items() if b not in covered]
        if not paths:
            return self.spark.createDataFrame([], DELTA)
        deltas = self.spark.read.schema(DELTA).parquet(*paths)
        return deltas.groupBy(*KEY).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).where("documents <> 0 OR tokens <> 0")

    def compact(self) -> None:
        """Fold all deltas committed by now into one, whose commit covers theirs; then their files may go.

        Sums and covers come from one listing, so a batch that is committed meanwhile is in neither.
        """
        done = self._commits()
        covers = f"{self.folder}/covers/{uuid.uuid4().hex}"
        names = self.spark.createDataFrame([(b,) for b in done], "batch string")
        for older in [c["covers"] for c in done.values() if "covers" in c]:
            names = names.unionByName(self.spark.read.schema("batch string").parquet(older))
        names.distinct().write.parquet(covers)
        if self._apply(f"compact-{uuid.uuid4().hex}", self._sum(done), {"covers": covers}):
            for batch, c in done.items():
                delete(self.spark, self._commit_path(batch))
                delete(self.spark, c["data"])
                if "covers" in c:
                    delete(self.spark, c["covers"])


def counted(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """source, lang and three counts of each document: blank-separated words, words of letters and digits, tokens."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = WordCachedTokenizer.shared(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [x or "" for x in part.column("text").to_pylist()]
                counts = [[len(x.encode().split()) for x in texts], [len(_WORD.findall(x)) for x in texts], [len(x) // 4 for x in tok.encode(texts)]]
                yield pa.RecordBatch.from_arrays(
                    [part.column("source"), part.column("lang"), *[pa.array(c, pa.int64()) for c in counts]], names=["source", "lang", "blank_words", "words", "tokens"]
                )

    columns = [F.col(c).cast("string").alias(c) for c in ("source", "lang", "text")]
    return docs.select(*columns).mapInArrow(task, "source string, lang string, blank_words long, words long, tokens long")


def op4_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table in four batches: loaded under two tokenizer versions, one of these revised, very short texts deleted and put back.

    The first batch is sent twice, as after a lost answer, and counts once. The totals are those of all documents.
    """
    rows = Scratch(spark, "token-counts").save(counted(table(spark, sf_dir, "documents")), "counts")
    rollup = Rollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    load = signed(rows, "words", "blank_words", 1).unionByName(signed(rows, "word_bpe_49k", "tokens", 1))
    rollup.commit("load", load)
    rollup.commit("load", load)
    rollup.commit("revise-words", signed(rows, "words", "blank_words", -1).unionByName(signed(rows, "words", "words", 1)))
    short = rows.where(F.col("words") < LEAST_WORDS)
    for batch, sign in (("delete-short", -1), ("restore-short", 1)):
        rollup.commit(batch, signed(short, "words", "words", sign).unionByName(signed(short, "word_bpe_49k", "tokens", sign)))
    rollup.compact()
    return rollup.totals()
