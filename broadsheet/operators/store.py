"""Articles, entities and lexicon as one store with atomic, repeatable commits.

A batch is written into folders of its own (``articles/batch=..``, ``entities/batch=..`` and so on) and counts from the moment
its manifest, one small file, appears under ``commits/`` by a rename. Readers take listed batches only. So
a run that stops half-way changes nothing, repeating it overwrites its own folders, and repeating a committed
batch is no work at all. ``compact`` folds all batches into one, which takes their place the same way.

One writer at a time, as entity names are resolved against the lexicon of all batches before.
Rows without a uid can't be recognised again and are left out.
"""

from __future__ import annotations

import datetime
import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from broadsheet.operators import entities, files, ingest, known_ids, search
from broadsheet.operators.ranking import top_per_group
from broadsheet.schemas import ARTICLES, ENTITIES, ENTITY_LEXICON
from broadsheet.session import cut_lineage

_NORMS = [T.StructField(search.norm_column(s), T.DoubleType()) for s in ("english", "multilingual")]
TABLES: dict[str, T.StructType] = {
    "articles": T.StructType([*ARTICLES.fields, *_NORMS, T.StructField("day", T.DateType())]),
    "entities": ENTITIES,
    "lexicon": ENTITY_LEXICON,
    "known": known_ids.KNOWN,
    "filters": known_ids.FILTERS,
}
_PARTED = {"articles": "day", "known": "bucket"}
_BATCH_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9.-]*")


class Store:
    """A store below a folder that every executor can reach."""

    def __init__(self, spark: SparkSession, root: str, layout: known_ids.Layout | None = None):
        """Opens a store; the layout of the known ids is fixed by whoever opens it first."""
        self.spark, self.root = spark, root
        files.publish(spark, f"{root}/layout.json", json.dumps(vars(layout or known_ids.Layout())))
        self.layout = known_ids.Layout(**json.loads(files.read(spark, f"{root}/layout.json")))

    def batches(self) -> list[str]:
        """Committed batches that no other has taken the place of."""
        names = files.names(self.spark, f"{self.root}/commits")
        said = [json.loads(files.read(self.spark, f"{self.root}/commits/{n}")) for n in names]
        replaced = {b for s in said for b in s["replaces"]}
        return [s["batch"] for s in said if s["batch"] not in replaced]

    def is_committed(self, batch: str) -> bool:
        return batch in files.names(self.spark, f"{self.root}/commits")

    def _folder(self, table: str, batch: str) -> str:
        return f"{self.root}/{table}/batch={batch}"

    def read(self, table: str) -> DataFrame:
        """A table as of the batches committed now."""
        found = self.batches()
        if not found:
            return self.spark.createDataFrame([], TABLES[table])
        rows = self.spark.read.schema(TABLES[table]).option("basePath", f"{self.root}/{table}")
        return rows.parquet(*(self._folder(table, b) for b in found)).select(TABLES[table].names)

    def _write(self, table: str, batch: str, rows: DataFrame) -> None:
        chosen = rows.select(*(F.col(f.name).cast(f.dataType) for f in TABLES[table].fields))
        by = _PARTED.get(table)
        # Rebalancing gives each part few files and splits one that holds most of the rows.
        writer = (chosen.hint("rebalance", by) if by else chosen).write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(self._folder(table, batch))

    def unseen(self, rows: DataFrame, mail: bool = False) -> DataFrame:
        """Rows whose uid is not stored; for mail neither with the prefix that older ids carry.

        Reads the ids of those buckets only that may hold one of the rows'.
        """
        spellings = [F.col("uid")] + ([F.concat(F.lit(ingest.OLD_MAIL_PREFIX), "uid")] if mail else [])
        asked = cut_lineage(rows.select(F.explode(F.array(*spellings)).alias("uid")).distinct())
        filter_rows = known_ids.merged([self.read("filters")])
        buckets = known_ids.buckets_to_read(asked, filter_rows, self.layout)
        if not buckets:
            return rows
        stored = self.known_in(buckets)
        for spelling in spellings:
            rows = rows.join(stored.select(F.col("uid").alias("_stored")), spelling == F.col("_stored"), "left_anti")
        return rows

    def known_in(self, buckets: list[int]) -> DataFrame:
        """Stored ids of some buckets; the others' files are not read."""
        return self.read("known").filter(F.col("bucket").isin(buckets))

    def stage(self, batch: str, rows: DataFrame, order: list[str], at: datetime.datetime | Column, mail: bool = False) -> None:
        """Writes the folders of a batch without committing it.

        ``rows`` are articles with ``entities_json``; of those with one uid the first by ``order`` counts, and
        names are resolved in that order. ``at``: when new lexicon rows are made.
        """
        if not _BATCH_NAME.fullmatch(batch):
            raise ValueError(f"not a batch name: {batch!r}")
        ranks = [F.asc(c) for c in order]
        # One reading of the models' answers, for the ids that are asked for and for all tables.
        once = cut_lineage(top_per_group(rows.filter("uid IS NOT NULL"), ["uid"], ranks))
        fresh = self.unseen(once, mail)
        if fresh is not once:
            fresh = cut_lineage(fresh)
        dated = search.with_norms(fresh).withColumn("day", F.to_date("datetime"))
        self._write("articles", batch, dated)
        found = entities.mentions(fresh, F.col("entities_json"), F.struct(*order, "uid"))
        lexicon = cut_lineage(self.read("lexicon"))
        resolved, additions = entities.resolve(found, lexicon)
        self._write("entities", batch, resolved)
        self._write("lexicon", batch, entities.lexicon_additions(lexicon, additions, F.lit(at)))
        self._write("known", batch, known_ids.known(fresh, self.layout))
        self._write("filters", batch, known_ids.filters(fresh, self.layout))

    def publish(self, batch: str, replaces: list[str] | None = None) -> bool:
        return files.publish(self.spark, f"{self.root}/commits/{batch}", json.dumps({"batch": batch, "replaces": replaces or []}))

    def commit(self, batch: str, rows: DataFrame, order: list[str], at: datetime.datetime | Column, mail: bool = False) -> bool:
        """Stages and publishes a batch; False, and nothing done, if it is committed already."""
        if self.is_committed(batch):
            return False
        self.stage(batch, rows, order, at, mail)
        return self.publish(batch)

    def compact(self, batch: str) -> bool:
        """Folds all batches into one. Folders of the old ones stay for readers that have begun."""
        old = self.batches()
        if self.is_committed(batch) or not old:
            return False
        for table in TABLES:
            rows = self.read(table)
            self._write(table, batch, known_ids.merged([rows]) if table == "filters" else rows)
        return self.publish(batch, old)

    def each_batch(self, name: str, analysed: Callable[[DataFrame], DataFrame], order: list[str], at: datetime.datetime | Column) -> Callable[[DataFrame, int], None]:
        """A function for ``foreachBatch``: a micro-batch that a stream repeats is committed once."""

        def write(rows: DataFrame, number: int) -> None:
            batch = f"{name}-{number}"
            if not self.is_committed(batch):
                self.commit(batch, analysed(rows), order, at)

        return write
