"""Exact dedup by combining in three stages, each of which compares whole contents.

1. Within a batch rows of one digest and equal bytes are one local group; its best row is the leader and
   alone keeps the text.
2. Leaders whose digest no other batch has are done.  Those of a digest that several batches have are spread
   over salts, so many that about SALT_ROWS of them meet, and leaders of equal text become one.
3. The winners of all salts of a digest are grouped by their text again.

Who stays goes back the same way, winner to salt, salt to local group, local group to rows, by numbers: no
join has a key that more rows share than a batch has, and no text is shuffled that occurs in one batch only.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cotejo.llm.kernels import free_name
from cotejo.plans.joins import SALTS, salted
from cotejo.plans.saved import saved

#: Leaders of one digest that meet at a salt, about.
SALT_ROWS = 256
#: Rows of a partition are numbered from its number times this.
ROWS = 1 << 33


def sha256(text: bytes) -> bytes:
    return hashlib.sha256(text).digest()


def _groups(texts: list[str], ids: list[int | None], largest: bool, digest: Callable[[bytes], bytes]) -> tuple[list[int], list[bytes]]:
    """For each row its local group's leader (an index), and its digest."""
    sign = 1 if largest else -1
    found: dict[bytes, list[list[int]]] = {}  # several groups of one digest only where it collides
    digests = []
    for i, text in enumerate(texts):
        digests.append(digest(text.encode()))
        groups = found.setdefault(digests[i], [])
        own = next((g for g in groups if texts[g[0]] == text), None)
        if own is None:
            groups.append([i])
        else:
            own.append(i)
    best = [0] * len(texts)
    for group in (g for groups in found.values() for g in groups):
        top = max(group, key=lambda i: (ids[i] is not None, sign * (ids[i] or 0), sign * i))
        for i in group:
            best[i] = top
    return best, digests


def local_groups(docs: DataFrame, largest: bool, names: dict[str, str], digest: Callable[[bytes], bytes]) -> DataFrame:
    """docs (doc_id and text among its columns) with names: row, its group's leader (a row), the leader's doc_id and the group's size; digest; and content, which only leaders have, in place of text."""
    columns = [c for c in docs.columns if c != "text"]
    kinds = {"row": T.LongType(), "leader": T.LongType(), "best": T.LongType(), "size": T.LongType(), "digest": T.BinaryType(), "content": T.StringType()}
    schema = T.StructType([*(f for f in docs.schema.fields if f.name != "text"), *(T.StructField(names[n], kind) for n, kind in kinds.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() * ROWS
        for batch in batches:
            texts, ids = [t or "" for t in batch.column("text").to_pylist()], batch.column("doc_id").to_pylist()
            best, digests = _groups(texts, ids, largest, digest)
            count = Counter(best)
            added = [
                pa.array(range(first, first + len(texts)), pa.int64()),
                pa.array([first + i for i in best], pa.int64()),
                pa.array([ids[i] for i in best], pa.int64()),
                pa.array([count[i] for i in best], pa.int64()),
                pa.array(digests, pa.binary()),
                pa.array([t if best[i] == i else None for i, t in enumerate(texts)], pa.string()),
            ]
            first += len(texts)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *added], names=schema.names)

    return docs.mapInArrow(run, schema)


def exact_copies(
    docs: DataFrame, largest: bool = True, normalise: Column | None = None, texts: bool = False, salt_rows: int = SALT_ROWS, digest: Callable[[bytes], bytes] = sha256
) -> DataFrame:
    """Every column of docs but text, with keep_id, group_size (long), kept (boolean) and text_sha256 (lower-case hex).

    docs has doc_id (long) and text.  Rows are copies if their texts are the same bytes, after ``normalise`` (a
    column of docs; None: no change); null is the empty text.  Of copies one row is kept: that of the largest doc_id
    (largest False: the smallest), of several of these the one read last (first); rows without doc_id come
    behind all others, and where all copies lack it keep_id is null.  group_size counts rows, repeated ones
    too.  An empty table gives an empty one.  Columns of docs of the added names are replaced.  texts: rows
    that are kept have their (normalised) text in the column text, others null.

    ``digest`` only finds copies, bytes decide; text_sha256 shows it.
    """
    docs = docs.drop("keep_id", "group_size", "kept", "text_sha256")
    if normalise is not None:
        docs = docs.withColumn("text", normalise)
    columns = [c for c in docs.columns if c != "text"]
    names: dict[str, str] = {}
    for n in ("row", "leader", "best", "size", "digest", "content", "salt", "group", "winner", "total"):
        names[n] = free_name([*docs.columns, *names.values()], f"_{n}")
    row, leader, best, size, key, content, salt, group, winner, total = names.values()
    rows = saved(local_groups(docs, largest, names, digest))

    leaders = rows.where(F.col(row) == F.col(leader))
    often = leaders.groupBy(key).agg(F.count("*").alias(total)).where(F.col(total) > 1)
    marks = salted(leaders.select(key, leader), often, [key], leader, F.lit(SALTS)).select(leader, F.pmod(F.xxhash64(leader), F.ceil(F.col(total) / salt_rows)).alias(salt))
    # what makes a leader the one that stays, largest first
    rank = F.struct(F.col(best).isNotNull().alias("known"), (F.col(best) if largest else -F.col(best)).alias("id"), (F.col(leader) if largest else -F.col(leader)).alias("row"))
    spread = leaders.select(leader, key, content, rank.alias(winner), size).join(marks.hint("shuffle_hash"), leader)
    merged = spread.groupBy(key, salt, content).agg(F.max(winner).alias(winner), F.sum(size).alias(total), F.min(leader).alias(group), F.collect_list(leader).alias(leader))
    merged = saved(merged)
    final = merged.groupBy(key, content).agg(F.max(winner).alias(winner), F.sum(total).alias(total), F.collect_list(group).alias(group))
    final = final.select(F.explode(group).alias(group), winner, total)
    told = merged.select(group, F.explode(leader).alias(leader)).join(final, group).select(leader, winner, total)

    sign = F.lit(1 if largest else -1)
    of = rows.select(*columns, row, leader, best, size, key, *([content] if texts else [])).join(told.hint("shuffle_hash"), leader, "left")
    joined = F.col(total).isNotNull()
    kept = F.col(row) == F.when(joined, F.col(winner)["row"] * sign).otherwise(F.col(leader))
    out = {
        "keep_id": F.when(joined, F.col(winner)["id"] * sign).otherwise(F.col(best)),
        "group_size": F.coalesce(total, size),
        "kept": kept,
        "text_sha256": F.lower(F.hex(key)),
    }
    if texts:
        out["text"] = F.when(kept, F.col(content))
    return of.select(*columns, *[c.alias(n) for n, c in out.items()])


def deduplicate(docs: DataFrame, largest: bool = True, normalise: Column | None = None) -> DataFrame:
    """The rows of docs that exact_copies keeps, with their (normalised) texts, null ones as ''."""
    columns = docs.columns
    return exact_copies(docs, largest, normalise, texts=True).where("kept").select(*columns)
