"""Scores of documents against a stated query set that goes to every task as a matrix.

What documents have of the queries' terms is dealt by document; each partition scores its documents in blocks of NumPy matrices and keeps the
best k of each query, so that no row for a (query, document) pair is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType

from tessera.session import ship, stored

#: Weighted query terms up to this number, and matrices of terms and queries up to so many numbers, go to every task; more are joined.
BROADCAST_ROWS, MATRIX = 50_000, 4_000_000
#: Postings of a partition in which documents are scored.
HITS = 250_000

Score = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


class Asked:
    """Queries (query_id, term, and a weight): names, wanted terms, and the weights as a matrix of terms and queries."""

    def __init__(self, rows: list, weight: str, kind: StructField):
        self.names, self.wanted, self.kind = sorted({r["query_id"] for r in rows}), sorted({r["term"] for r in rows}), kind
        at, column = {n: i for i, n in enumerate(self.names)}, {t: i for i, t in enumerate(self.wanted)}
        self.weight = np.zeros((len(self.wanted), len(self.names)))
        self.has = np.zeros((len(self.wanted), len(self.names)), bool)
        for r in rows:
            self.weight[column[r["term"]], at[r["query_id"]]] = r[weight]
            self.has[column[r["term"]], at[r["query_id"]]] = True

    @staticmethod
    def of(queries: DataFrame, weight: str) -> tuple[Asked | None, list]:
        """None if they are too many for a matrix; and the rows."""
        rows = queries.limit(BROADCAST_ROWS + 1).collect()
        if len(rows) > BROADCAST_ROWS or len({r["query_id"] for r in rows}) * len({r["term"] for r in rows}) > MATRIX:
            return None, rows
        return Asked(rows, weight, queries.schema["query_id"]), rows

    def places(self, df: DataFrame) -> DataFrame:
        """(term, i) for a broadcast."""
        return F.broadcast(df.sparkSession.createDataFrame(list(enumerate(self.wanted)), "i int, term string"))


def scores(asked: Asked, hits: DataFrame, docs: DataFrame | None, score: Score, parts: int | None, k: int | None, digits: int | None, descending: bool = True, name: str = "score") -> DataFrame:
    """(query_id, doc_id, score): of each partition the best k of each query (k None: all candidates).

    hits: (doc_id, i, v), what a document has of wanted term i; docs: (doc_id, v, rest), two numbers of each document, also of one without
    a hit (None: 0).  parts: None if the hits aren't counted yet; they are written then.  score(own, has, v, rest) gives a matrix of documents and queries, NaN where a document is no candidate; own has 0 and has False where
    a term is missing.  Null ids are left out.
    """
    ship(hits.sparkSession)
    if parts is None:
        hits = stored(hits, "hits")
        parts = max(1, -(-hits.count() // HITS))
    rows = hits.select("doc_id", "i", F.col("v").cast("double"), F.lit(0.0).alias("rest"))
    if docs is not None:
        rows = rows.unionByName(docs.select("doc_id", F.lit(-1).alias("i"), "v", "rest"))
    rows = rows.where("doc_id IS NOT NULL")
    names, wide, sign = asked.names, len(asked.wanted), 1.0 if descending else -1.0
    name_type = to_arrow_type(asked.kind.dataType)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = [b for b in batches if b.num_rows]
        if not given or not names:
            return
        table = pa.Table.from_batches(given).combine_chunks()
        ids = table["doc_id"].combine_chunks().dictionary_encode()
        order = pc.array_sort_indices(ids.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        doc, term, value = place[ids.indices.to_numpy()], table["i"].to_numpy(), table["v"].to_numpy()
        own_rows = term < 0
        v, rest = np.zeros(len(order)), np.zeros(len(order))
        v[doc[own_rows]], rest[doc[own_rows]] = value[own_rows], table["rest"].to_numpy()[own_rows]
        by_doc = np.argsort(doc[~own_rows], kind="stable")
        doc, term, value = doc[~own_rows][by_doc], term[~own_rows][by_doc], value[~own_rows][by_doc]
        size = max(1, min(4096, MATRIX // max(1, wide, len(names))))
        for first in range(0, len(order), size):
            n = min(size, len(order) - first)
            a, b = np.searchsorted(doc, (first, first + n))
            own, has = np.zeros((n, wide)), np.zeros((n, wide), bool)
            own[doc[a:b] - first, term[a:b]] = value[a:b]
            has[doc[a:b] - first, term[a:b]] = True
            found = score(own, has, v[first : first + n], rest[first : first + n])
            if digits is not None:
                found = np.round(found, digits)
            goal = np.where(np.isnan(found), -np.inf, sign * found).T
            row, col = np.nonzero(goal > -np.inf)
            if k is not None:
                m = min(k, n)
                least = -np.partition(-goal, m - 1, axis=1)[:, m - 1 : m]
                row, col = np.nonzero((goal >= least) & (goal > -np.inf))
                top = np.lexsort((col, -goal[row, col], row))
                row, col = row[top], col[top]
                keep = np.arange(len(row)) - np.searchsorted(row, np.arange(len(names)))[row] < m
                row, col = row[keep], col[keep]
            yield pa.RecordBatch.from_arrays([pa.array(names, name_type).take(pa.array(row)), ids.dictionary.take(pa.array(order[first + col])), pa.array(found[col, row])], ["query_id", "doc_id", name])

    made = StructType([StructField("query_id", asked.kind.dataType), StructField("doc_id", hits.schema["doc_id"].dataType), StructField(name, DoubleType())])
    return rows.repartition(parts, "doc_id").mapInArrow(near, made)


def meets(has: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Which documents have a term of which queries."""
    return has.astype(np.float32) @ asked.astype(np.float32) > 0
