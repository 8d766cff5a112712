"""The job tool surface over tables (UDF03, SRC05, RM01-RM02, RM15-RM17, UPS01-UPS05, UPS12, AG10).

An ``Engine`` keeps units, chunks and translations of jobs below one folder, as a base and the changes after it.
A step reads what is complete, derives the changed units with the operators and writes them alone under a number
that it claimed, so two writers never take the same one and readers never see half a write.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..operators import chunking, contracts, html, markdown, translation
from ..functions.text import invariant_warnings, is_blank

_UNITS = "job_id string, unit_id string, pos int, section_id string, kind string, original string, chunk long, japanese string, saved_at timestamp, warnings array<string>"


class Engine:
    def __init__(self, spark: SparkSession, root: str, most: int = chunking.JOB_MAX):
        self.spark, self.root, self.most = spark, root.rstrip("/"), most

    # snapshots ----------------------------------------------------------------

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _versions(self) -> tuple[int, list[int]]:
        """The last base (0: none) and the changes after it that are complete."""
        fs, p = self._fs(self.root)
        if not fs.exists(p):
            return 0, []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        done = [n for n in names if n[0] in "bv" and fs.exists(self._fs(f"{self.root}/{n}/_SUCCESS")[1])]
        base = max((int(n[1:]) for n in done if n[0] == "b"), default=0)
        return base, sorted(int(n[1:]) for n in done if n[0] == "v" and int(n[1:]) > base)

    def units(self) -> DataFrame:
        """All units as they stand: of each one the row of the last change."""
        base, changes = self._versions()
        names = [f"b{base}"] * (base > 0) + [f"v{v}" for v in changes]
        if not names:
            return self.spark.createDataFrame([], _UNITS)
        rows = [
            self.spark.read.schema(_UNITS).parquet(f"{self.root}/{n}").withColumn("__at", F.lit(int(n[1:]))) for n in names
        ]
        if len(rows) == 1:
            return rows[0].drop("__at")
        columns = [c.split()[0] for c in _UNITS.split(", ")]
        whole = reduce(DataFrame.unionByName, rows)
        last = whole.groupBy("job_id", "unit_id").agg(F.max_by(F.struct(*columns), "__at").alias("u"))
        return last.select("u.*")

    def _claim(self) -> int:
        """A number that no other writer has: whoever creates the file owns it."""
        base, changes = self._versions()
        n = max([base, *changes]) + 1
        while True:
            if storage.create_new(self.spark, f"{self.root}/claims/{n}"):
                return n
            n += 1

    def _publish(self, units: DataFrame, kind: str = "v") -> None:
        """Write changed units as a version of their own; readers see it once it is complete."""
        n = self._claim()
        units.select(*[c.split()[0] for c in _UNITS.split(", ")]).write.parquet(f"{self.root}/{kind}{n}")

    def compact(self) -> None:
        """Make one base of all changes and delete what it replaces; to be run while nobody reads or saves."""
        base, changes = self._versions()
        self._publish(self.units(), "b")
        for name in [f"b{base}"] * (base > 0) + [f"v{v}" for v in changes]:
            storage.delete(self.spark, f"{self.root}/{name}")

    # steps --------------------------------------------------------------------

    def acquire(self, pages: DataFrame) -> DataFrame:
        """SRC05, RM01: official pages, parsed and sanitised, as translation units with their sections."""
        fine = pages.where(contracts.page_origin_problem(F.col("url")).isNull())
        nodes = storage.materialise(html.sanitize(html.node_table(fine, "job_id")), "clean")
        own = html.section_of(nodes, html.unit_nodes(nodes))
        return own.select(F.col("doc_id").alias("job_id"), "unit_id", F.col("pre").cast("int").alias("pos"), "section_id", "kind", F.col("source_text").alias("original"))

    def prepare(self, units: DataFrame) -> None:
        """UPS01: adds jobs; a job that exists is left as it is (resume)."""
        if not chunking.ALLOWED[0] <= self.most <= chunking.ALLOWED[1]:
            raise ValueError("a chunk holds 1000 to 30000 characters")
        have = self.units()
        new = units.join(have.select("job_id").distinct(), "job_id", "left_anti")
        packed = chunking.pack_sections(new, ["job_id"], "pos", "section_id", F.length("original"), self.most).select(*new.columns, "chunk")
        packed = packed.withColumns({"japanese": F.lit(""), "saved_at": F.lit(None).cast("timestamp"), "warnings": F.array().cast("array<string>")})
        self._publish(packed)

    def status(self) -> DataFrame:
        """AG10, RM16: progress of each job."""
        return chunking.job_progress(chunking.chunk_status(self.units(), ["job_id"], "japanese"), ["job_id"])

    def list_jobs(self) -> DataFrame:
        """RM15: jobs by their last change."""
        return self.units().groupBy("job_id").agg(F.max("saved_at").alias("updated_at"), F.count("*").alias("units")).orderBy(F.desc_nulls_last("updated_at"), "job_id")

    def next_chunks(self) -> DataFrame:
        """UPS05: payload of each job's first open chunk."""
        todo = chunking.next_pending(chunking.chunk_status(self.units(), ["job_id"], "japanese"), ["job_id"])
        rows = self.units().join(todo, ["job_id", "chunk"]).withColumn("source_text", F.col("original"))
        return translation.payloads(rows, ["job_id"], "pos")

    def save(self, job_id: str, chunk: int, arriving: DataFrame, overwrite: bool = False) -> list:
        """UPS02: takes (unit_id, japanese); returns the problems and changes nothing if there is one."""
        units = self.units()
        own = units.where((F.col("job_id") == job_id) & (F.col("chunk") == chunk))
        problems = translation.identity_problems(own, arriving, [], "unit_id").collect()  # a chunk's units at most
        new = arriving.withColumn("saved_at", F.current_timestamp())
        done = own.where(~is_blank(F.col("japanese")))
        saved = translation.save(done.select("unit_id", "japanese", "saved_at"), new, ["unit_id"], overwrite)
        problems += saved.where("action in ('conflict','blank')").select("unit_id", F.col("action").alias("problem")).collect()
        if problems:
            return problems
        s = saved.select(F.lit(job_id).alias("job_id"), "unit_id", F.col("japanese").alias("__ja"), F.col("saved_at").alias("__at"))
        out = own.join(s, ["job_id", "unit_id"])  # the chunk's changed units only
        warned = translation.ordered_distinct(F.col("warnings"), invariant_warnings(F.col("original"), F.col("__ja")))
        self._publish(out.withColumns({
            "warnings": F.when(F.col("__ja").isNotNull(), warned).otherwise(F.col("warnings")),
            "japanese": F.coalesce("__ja", "japanese"), "saved_at": F.coalesce("__at", "saved_at"),
        }))
        return []

    def finalize(self) -> DataFrame:
        """UPS04: (job_id, markdown) of the jobs without open chunks."""
        ready = self.status().where("remaining = 0").select("job_id")
        u = self.units().join(ready, "job_id", "left_semi").withColumn("level", F.lit(1))
        return markdown.serialize(markdown.blocks_of_units(u.withColumnRenamed("job_id", "doc_id"))).withColumnRenamed("doc_id", "job_id")

    def fingerprint(self) -> str:
        """UPS12, RM17: digest of the units' ids and texts, whatever their order."""
        rows = self.units().select(F.sha2(F.concat_ws("\u0000", "job_id", "unit_id", "original"), 256).alias("h"))
        total = rows.agg(F.sum(F.conv(F.substring("h", 1, 15), 16, 10).cast("decimal(38,0)"))).first()[0]
        return f"{int(total or 0):x}"
