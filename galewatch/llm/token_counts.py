"""Token counts by section: whole documents are encoded once, tokens are then dealt to sections.

Rule for a token that crosses a boundary: it counts for the section that holds most of its bytes;
where two hold as many, for the earlier one. So the counts of a document's sections always add up
to the tokens of the whole document.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from .pieces import _ship

#: What stands between the fields of a document; it belongs to the field before it.
BETWEEN = "\n\n"


@lru_cache(maxsize=2)
def _encoding(path: str, added: str | None, pattern: str):
    import tiktoken

    with open(SparkFiles.get(added) if added else path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    width = np.zeros(max(ranks.values()) + 1, np.int64)
    for piece, i in ranks.items():
        width[i] = len(piece)
    return tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), width


def deal(ends: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Section of every token and whether it crosses a boundary.

    ``ends``: end byte of each token, rising; ``bounds``: start byte of each section and the end of
    the last. An interval join of two sorted lists by binary search.
    """
    starts = np.r_[0, ends[:-1]]
    first = np.searchsorted(bounds, starts, "right") - 1
    last = np.searchsorted(bounds, ends, "left") - 1
    crosses = last > first
    home = first.copy()
    for t in np.flatnonzero(crosses):
        edges = np.clip(bounds[first[t] : last[t] + 2], starts[t], ends[t])
        home[t] = first[t] + int(np.argmax(np.diff(edges)))
    return home, crosses


def _line_bounds(data: bytes) -> np.ndarray:
    """Every line with its line feed is a section."""
    cuts = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    return np.r_[0, cuts[cuts < len(data)], len(data)]


def tokens_by_section(docs: DataFrame, ranks_path: str, pattern: str, fields: tuple[str, ...] = ("text",)) -> DataFrame:
    """doc_id, section (0, 1, ...), field, start, end (bytes of the joined fields), n_tokens, n_crossing.

    With one field its lines are the sections; with several, each field is one (empty and null
    fields too, with no bytes and no tokens of their own). A document without any text has no rows.
    Repeated rows are counted each.
    """
    added = _ship(docs, ranks_path)
    base = docs.select("doc_id", *[F.coalesce(F.col(f), F.lit("")).alias(f"f{i}") for i, f in enumerate(fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, width = _encoding(ranks_path, added, pattern)
        for batch in batches:
            out: list[list[np.ndarray]] = []
            rows: list[int] = []
            for i in range(batch.num_rows):
                parts = [batch.column(k + 1)[i].as_py() for k in range(len(fields))]
                text = BETWEEN.join(parts)
                data = text.encode()
                if len(fields) == 1:
                    bounds = _line_bounds(data)
                else:
                    sizes = [len(p.encode()) + (len(BETWEEN) if k + 1 < len(parts) else 0) for k, p in enumerate(parts)]
                    bounds = np.r_[0, np.cumsum(sizes)]
                if not data:
                    continue
                ids = encoding.encode_ordinary(text)
                ends = np.cumsum(width[ids])
                home, crosses = deal(ends, bounds)
                n = len(bounds) - 1
                out.append([np.arange(n), bounds[:-1], bounds[1:], np.bincount(home, minlength=n), np.bincount(home[crosses], minlength=n)])
                rows.append(i)
                if sum(len(o[0]) for o in out[-1:]) and len(out) >= 5000:
                    yield _table(batch, rows, out)
                    out, rows = [], []
            if out:
                yield _table(batch, rows, out)

    made = map_arrow(base, run, "doc_id long, section int, start long, end long, n_tokens long, n_crossing long")
    if len(fields) == 1:
        return made.withColumn("field", F.lit(fields[0]))
    return made.withColumn("field", F.element_at(F.array(*map(F.lit, fields)), F.col("section") + 1))


def _table(batch: pa.RecordBatch, rows: list[int], out: list[list[np.ndarray]]) -> pa.RecordBatch:
    sizes = np.array([len(o[0]) for o in out])
    ids = batch.column(0).take(pa.array(np.repeat(rows, sizes))).cast(pa.int64())
    cols = [np.concatenate([o[k] for o in out]) for k in range(5)]
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(cols[0], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[1:]]],
        names=["doc_id", "section", "start", "end", "n_tokens", "n_crossing"],
    )
