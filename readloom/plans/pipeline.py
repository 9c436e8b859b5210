"""A restartable chain of steps: each writes a table, and a step whose table is complete is not run again."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class PipelineConfig:
    """Parameters of an RNA analysis; saved and loaded as JSON."""

    output: str = "."
    min_intron: int = 20
    min_block: int = 0
    max_strata_after_best: int | None = None
    unique_level: int | None = None
    max_maps: int = 25
    exon_overlap: float = 1.0
    junction_coverage: int = 2
    junction_distance: tuple[int, int] = (4, 500_000)
    count_pairs: bool = True
    count_multimaps: bool = False
    count_weighted: bool = False
    extra: dict = field(default_factory=dict)

    def save(self, path: str) -> None:
        with open(path, "w") as f:
            json.dump(asdict(self), f, indent=2)

    @classmethod
    def load(cls, path: str) -> PipelineConfig:
        with open(path) as f:
            d = json.load(f)
        d["junction_distance"] = tuple(d["junction_distance"])
        return cls(**d)


@dataclass
class Step:
    name: str
    run: Callable[..., DataFrame]
    needs: tuple[str, ...] = ()
    final: bool = True


class Pipeline:
    """Steps by name, run in order of their needs. ``temporary`` steps are dropped by :meth:`cleanup`."""

    def __init__(self, spark: SparkSession, output: str, steps: list[Step]):
        self.spark, self.output = spark, output.rstrip("/")
        self.steps = {s.name: s for s in steps}

    def path(self, name: str) -> str:
        return f"{self.output}/{name}"

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def is_done(self, name: str) -> bool:
        fs, p = self._fs(f"{self.path(name)}/_SUCCESS")
        return fs.exists(p)

    def order(self, only: list[str] | None = None) -> list[str]:
        """Steps in order of their needs; with ``only`` those and what they need."""
        out: list[str] = []

        def visit(n: str, above: tuple[str, ...] = ()) -> None:
            if n in above:
                raise ValueError("steps need each other: " + " > ".join([*above, n]))
            for k in self.steps[n].needs:
                visit(k, (*above, n))
            if n not in out:
                out.append(n)

        for n in only or self.steps:
            visit(n)
        return out

    def run(self, only: list[str] | None = None, force: bool = False, dry: bool = False) -> list[str]:
        """Runs what is not done (or everything, if ``force``) and tells the names; ``dry`` only tells."""
        todo = [n for n in self.order(only) if force or not self.is_done(n)]
        for n in [] if dry else todo:
            s = self.steps[n]
            s.run(*(self.table(k) for k in s.needs)).write.mode("overwrite").parquet(self.path(n))
        return todo

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def cleanup(self) -> list[str]:
        """Drops the tables of steps that are not final."""
        gone = [n for n, s in self.steps.items() if not s.final and self.is_done(n)]
        for n in gone:
            fs, p = self._fs(self.path(n))
            fs.delete(p, True)
        return gone


def rna_pipeline(spark: SparkSession, config: PipelineConfig, maps: DataFrame, annotation: DataFrame, pairs: DataFrame | None = None) -> Pipeline:
    """Filter mappings, count genes, find junctions and summarise: the parts of an RNA analysis behind the mapper.

    ``maps`` are templates with a column ``template``; ``pairs``, if there are any, paired templates with the same column.
    With ``count_pairs`` only pairs count, if ``pairs`` are given. ``extra`` holds further filter options by name.
    """
    from pyspark.sql import functions as F

    from readloom.operators import filters as P
    from readloom.operators import intervals as I
    from readloom.operators import junctions as J
    from readloom.operators import stats as A
    from readloom.operators import templates as T

    opts = P.FilterOptions(min_intron=config.min_intron, min_block=config.min_block or None, max_strata_after_best=config.max_strata_after_best, unique_level=config.unique_level, to_max_maps=config.max_maps, **config.extra)

    def blocks(t: DataFrame) -> DataFrame:
        b = T.block_rows(t, ("template",))
        return b.select("template", "map_no", F.lit(1).alias("end_no"), F.lit(1).alias("n_ends"), "block_no", "n_blocks", "seq_name", "strand", F.col("start_pos").alias("b_start"), F.col("end_pos").alias("b_end"))

    def count(b: DataFrame) -> DataFrame:
        both = config.count_pairs and pairs is not None
        return I.gene_counts(b.unionByName(I.pair_blocks(pairs, "template")) if both else b, annotation, config.count_multimaps, config.count_weighted, config.exon_overlap, paired=both)

    def junctions(b: DataFrame) -> DataFrame:
        lo, hi = config.junction_distance
        near = J.from_mappings(b, ["template", "map_no"]).where((F.col("right") - F.col("left")).between(lo, hi))
        return J.supported(near, J.from_annotation(annotation), config.junction_coverage)

    return Pipeline(spark, config.output, [
        Step("filtered", lambda: P.filter_templates(maps, opts)),
        Step("blocks", blocks, ("filtered",), final=False),
        Step("counts", count, ("blocks",)),
        Step("junctions", junctions, ("blocks",)),
        Step("statistics", lambda t: A.general(t), ("filtered",)),
    ])
