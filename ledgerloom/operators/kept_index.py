"""A fitted index of vectors, kept on disk, queried often and kept up to date.

:meth:`SemanticIndex.fit` places every row in the cell of a near pivot and writes the rows as Parquet,
partitioned by cell, with a table of the cells beside them.  :meth:`SemanticIndex.retrieve` works out from
that table which cells the triangle inequality cannot rule out, and reads only those partitions.
:meth:`SemanticIndex.update` writes the cells that corrections and new lines touch, and no others.

On disk, below the index's folder::

    rows/generation=G/cell=C/*.parquet    idx, text, labels, unit vector, angle to the pivot
    cells/generation=G/*.parquet          one row per cell: its pivot, where its rows are, their number and angles

Each update is a new generation: it writes its cells' rows first and the table of cells last.  Readers
follow the newest complete table of cells, so an update that fails midway changes nothing, and an index
opened before an update still reads what it saw.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace
from math import isqrt, pi

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.config import LABEL_COLUMNS, TOP_K
from ledgerloom.operators import retrieval
from ledgerloom.operators.review import merge_corrections
from ledgerloom.scale import hash_key, settle, small_side

#: Cells at most, and bytes that their pivots may take on the driver and in each task.
MAX_CELLS = 4096
MAX_PIVOT_BYTES = 32 * 1024 * 1024
#: Rows that one file of a cell is meant to hold at most.
FILE_ROWS = 1_000_000
PAYLOAD = retrieval.PAYLOAD


@dataclass(frozen=True)
class SemanticIndex:
    """An index on disk.  ``cells`` maps a cell's number to ``(generation, rows, least angle, largest angle)``."""

    spark: SparkSession
    path: str
    generation: int
    pivots: np.ndarray
    cells: dict[int, tuple[int, int, float, float]]
    schema: T.StructType

    # ---- making and opening ----

    @classmethod
    def fit(cls, index: DataFrame, path: str, max_cells: int = MAX_CELLS, seed: int = 42) -> SemanticIndex:
        """Write the index of ``index (idx, embedding, text, labels)`` to ``path``, a folder that all executors share.

        ``idx`` is unique; there are about as many cells as the root of the rows, but no more than
        ``max_cells`` and than MAX_PIVOT_BYTES allow.  Pivots are rows chosen by a hash of ``idx``, so the
        same rows give the same index however they are partitioned.  Zero vectors form a cell of their own;
        vectors that are null or differ in length raise an error.
        """
        pivots = cls._pivots(index, max_cells, seed)
        made = cls(index.sparkSession, path.rstrip("/"), -1, pivots, {}, T.StructType())
        rows = made._placed(index)
        return replace(made, schema=rows.schema)._written(rows, 0, {})

    @staticmethod
    def _pivots(index: DataFrame, max_cells: int, seed: int) -> np.ndarray:
        head = index.select("embedding").where("embedding IS NOT NULL").first()
        dim = len(head[0]) if head else 1
        wanted = max(1, min(isqrt(index.count()), max_cells, MAX_PIVOT_BYTES // (8 * dim)))
        known = index.where(~F.forall("embedding", lambda x: x == 0))
        chosen = known.orderBy(hash_key("idx", seed), "idx").select("embedding").limit(wanted).toArrow()
        pivots = retrieval._matrix(chosen.column("embedding"))
        return pivots if len(pivots) else np.zeros((1, dim))

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> SemanticIndex:
        """The newest generation of the index at ``path``."""
        path = path.rstrip("/")
        table = spark.read.parquet(f"{path}/cells")
        newest = table.agg(F.max("generation")).first()[0]
        rows = table.where(F.col("generation") == newest).orderBy("cell").collect()  # at most MAX_CELLS
        pivots = np.array([r["pivot"] for r in rows if r["pivot"] is not None], dtype=float)
        cells = {r["cell"]: (r["rows_in"], r["rows"], r["low"], r["high"]) for r in rows if r["rows"]}
        return cls(spark, path, int(newest), pivots, cells, T.StructType.fromJson(json.loads(rows[0]["schema"])))

    # ---- reading ----

    def rows(self, cells: list[int] | None = None) -> DataFrame:
        """The rows of ``cells`` (all by default); partition filters keep other cells unread."""
        wanted = sorted(self.cells if cells is None else set(cells) & set(self.cells))
        schema = T.StructType([*self.schema.fields, T.StructField("generation", T.LongType())])
        whole = self.spark.read.schema(schema).parquet(f"{self.path}/rows")
        return whole.where(self._partitions(wanted)).drop("generation")

    def _partitions(self, cells: list[int]) -> Column:
        by_generation: dict[int, list[int]] = {}
        for cell in cells:
            by_generation.setdefault(self.cells[cell][0], []).append(cell)
        chosen = F.lit(False)
        for generation, own in sorted(by_generation.items()):
            chosen = chosen | ((F.col("generation") == generation) & F.col("cell").isin(own))
        return chosen

    def knn(self, queries: DataFrame, k: int = TOP_K, query_id: str = "query_id", block_rows: int = retrieval.BLOCK_ROWS) -> DataFrame:
        """``query_id, idx, distance, similarity, rank``: the exact ``k`` nearest rows, as :func:`retrieval.knn` gives them.

        The query key is unique.  First each query meets one pack of a near cell; its k-th distance there
        bounds the search.  Then it meets all rows of the cells within that bound; only those are read.
        """
        return self._knn(queries, k, query_id, block_rows)[0]

    def _knn(self, queries: DataFrame, k: int, query_id: str, block_rows: int) -> tuple[DataFrame, list[int]]:
        asked = settle(queries.select(F.col(query_id).alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding")))
        schema = retrieval._candidate_schema(queries, query_id, self.rows([]))
        if not self.cells or asked.isEmpty():
            return retrieval._no_answers(schema, queries), []
        sheet_rows = max(block_rows, retrieval.PACK_ROWS)
        cells = {c: retrieval._Cell(n, low, high) for c, (_, n, low, high) in self.cells.items()}
        cells = retrieval._pack(cells, self.pivots, sheet_rows)
        is_zero = F.forall("embedding", lambda x: x == 0)
        asking = asked.where(~is_zero)
        near = settle(retrieval._visits(asking, self.pivots, cells, k, True))
        pilot = retrieval._meet(self._blocks(self._asked(near), cells), near, k, schema, sheet_rows)
        found = pilot.groupBy("query_id").agg(F.count("*").alias("n"), F.max("distance").alias("bound"))
        bound = F.when(F.col("n") >= k, F.col("bound")).otherwise(F.lit(2.0))
        bounded = asking.join(found, "query_id", "left").select("query_id", "embedding", F.coalesce(bound, F.lit(2.0)).alias("bound"))
        visits = settle(retrieval._visits(bounded, self.pivots, cells, k, False))
        visited = self._asked(visits)
        met = retrieval._meet(self._blocks(visited, cells), visits, k, schema, sheet_rows)
        zero = asked.where(is_zero)
        if not zero.isEmpty():  # equally far from every row
            visited = sorted(self.cells)
            first = [r["idx"] for r in self.rows().select("idx").orderBy("idx").limit(k).collect()]
            same = F.array(*[F.lit(i) for i in first])
            met = met.unionByName(zero.select("query_id", F.explode(same).alias("idx"), F.lit(1.0).alias("distance")))
        best = retrieval._best_overall(met, k).withColumn("similarity", 1 - F.col("distance"))
        return best, visited

    def _blocks(self, cells: list[int], known: dict[int, retrieval._Cell]) -> DataFrame:
        rows = self.rows(cells).select("idx", "embedding", "cell")
        return retrieval._packed(rows, {c: known[c] for c in cells})

    @staticmethod
    def _asked(visits: DataFrame) -> list[int]:
        """The cells that any query asks for, at most MAX_CELLS."""
        return [r["cell"] for r in visits.select(F.explode("cells").alias("cell")).distinct().collect()]

    def retrieve(
        self, queries: DataFrame, k: int = TOP_K, query_id: str = "query_id", min_similarity: float | None = None,
        block_rows: int = retrieval.BLOCK_ROWS,
    ) -> DataFrame:
        """Nearest rows with their text and labels, read from the visited cells only."""
        winners, visited = self._knn(queries, k, query_id, block_rows)
        if min_similarity is not None:
            winners = winners.where(F.col("similarity") >= min_similarity)
        return winners.join(self.rows(visited).select("idx", *PAYLOAD), "idx").select(
            F.col("query_id").alias(query_id), "rank", "idx", *PAYLOAD, "distance", "similarity"
        )

    # ---- writing ----

    def _placed(self, index: DataFrame) -> DataFrame:
        """The rows with ``cell`` and ``angle``; vectors become unit vectors."""
        row = index.select(F.struct("idx", *PAYLOAD).alias("idx"), "embedding")
        placed = retrieval._to_cells(row, self.pivots, len(self.pivots))
        return placed.select("idx.*", "embedding", "angle", "cell")

    def _written(self, rows: DataFrame, generation: int, kept: dict[int, tuple[int, int, float, float]]) -> SemanticIndex:
        """Write ``rows`` as the cells of ``generation``, then the table of cells; ``kept`` cells stay where they are."""
        target = f"{self.path}/rows/generation={generation}"
        # A large cell is dealt to several tasks, each of which writes one file of it.
        counts = rows.groupBy("cell").agg(F.count("*").alias("_n"))
        parts = small_side(counts.select("cell", F.ceil(F.col("_n") / FILE_ROWS).cast("int").alias("_parts")))
        spread = rows.join(parts, "cell").withColumn("_part", F.pmod(F.xxhash64("idx"), F.col("_parts")))
        partitions = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = spread.repartition(partitions, "cell", "_part").drop("_parts", "_part")
        dealt.write.mode("overwrite").partitionBy("cell").parquet(target)
        cells = dict(kept)
        new = self.spark.read.schema(self.schema).parquet(target).groupBy("cell").agg(
            F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")
        )
        for r in new.collect():  # at most MAX_CELLS and the cell of zero vectors
            low, high = (pi / 2, pi / 2) if r["cell"] < 0 else (r["low"], r["high"])
            cells[r["cell"]] = (generation, r["n"], low, high)
        numbers = sorted(set(range(len(self.pivots))) | set(cells))
        table = [
            (c, *cells.get(c, (generation, 0, 0.0, 0.0)), self.pivots[c].tolist() if c >= 0 else None, self.schema.json()) for c in numbers
        ]
        schema = "cell int, rows_in long, rows long, low double, high double, pivot array<double>, schema string"
        self.spark.createDataFrame(table, schema).coalesce(1).write.mode("overwrite").parquet(
            f"{self.path}/cells/generation={generation}"
        )
        return replace(self, generation=generation, cells=cells)

    def update(self, corrections: DataFrame | None = None, lines: DataFrame | None = None) -> SemanticIndex:
        """The index with corrected labels and new lines; only the cells that they touch are read whole and written.

        ``corrections (idx, corrected_at, labels)`` as in :func:`review.merge_corrections`; ``lines`` as in
        :meth:`fit`, with unique ``idx``: a line whose ``idx`` is there already replaces that row, wherever its
        vector now belongs.  Corrections hold for new lines, too.  Cells of the rows concerned are found from
        the columns ``idx`` and ``cell`` alone.
        """
        if not self.cells and lines is not None:  # an empty index gets its pivots now
            if corrections is not None:
                lines = merge_corrections(lines, corrections)
            renewed = replace(self, pivots=self._pivots(lines, MAX_CELLS, 42))
            rows = renewed._placed(lines)
            return replace(renewed, schema=rows.schema)._written(rows, self.generation + 1, {})
        places = self.rows().select("idx", "cell")
        touched: list[DataFrame] = []
        new = None
        if lines is not None:
            new = settle(self._placed(lines))
            touched += [new.select("cell"), places.join(new.select("idx"), "idx", "left_semi").select("cell")]
        if corrections is not None:
            corrections = settle(corrections)
            touched.append(places.join(corrections.select("idx").distinct(), "idx", "left_semi").select("cell"))
        if not touched:
            return self
        both = touched[0]
        for part in touched[1:]:
            both = both.unionByName(part)
        cells = {r["cell"] for r in both.distinct().collect()}  # at most MAX_CELLS
        rows = self.rows(sorted(cells)).select("idx", *PAYLOAD, "embedding", "angle", "cell")
        if new is not None:
            rows = rows.join(new.select("idx"), "idx", "left_anti").unionByName(new.select(*rows.columns))
        if corrections is not None:
            columns = rows.columns
            rows = merge_corrections(rows, corrections).select(*columns)
        kept = {c: v for c, v in self.cells.items() if c not in cells}
        return self._written(rows, self.generation + 1, kept)
