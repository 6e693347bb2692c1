"""Chat formatting on a prefix tree.

A turn is a node under the turns before it; conversations that begin alike share those nodes.  A
segment is a chain of nodes that goes on until the tree branches or a conversation ends, so a
conversation is whole segments.  A node's path is the chain of the hashes of its segments' first nodes,
and nodes in the order of paths and depths are depth first.  In that order each node's formatted text
is emitted once, as tokens, into one stream:

* a segment's tokens are the stream interval from segment_start to segment_end; position_start is its place in its
  conversations, and the position ids of its tokens count up from there, alike for all that share it;
* ancestors are the stream intervals that a segment's tokens attend to besides what their own has before them,
  one for each segment above;
* loss_start and loss_end bound the tokens of a node's text that is trained on.

A conversation is read back from the stream by its last segment alone: the intervals tell its tokens, and
the position ids their order.

The template writes ``<s>role``, a line break, the text and ``</s>`` with a line break.  A backslash
goes into each ``<s>`` or ``</s>`` of a role or text behind the ``<`` (and one more where there are
some), and line breaks of a role become ``\\\\n``, so that formatted text reads back exactly.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cotejo.plans.joins import SALTS, salted
from cotejo.plans.saved import saved

#: The template's control strings.
START, END = "<s>", "</s>\n"
_HIDE, _SHOW = re.compile(r"<(\\*)(/?s>)"), re.compile(r"<\\(\\*)(/?s>)")
#: Bytes of a node's hash.
NODE = 16
TRAINED = "assistant"


def escape(text: str) -> str:
    return _HIDE.sub(r"<\1\\\2", text)


def unescape(text: str) -> str:
    return _SHOW.sub(r"<\1\2", text)


def _escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(\\|n)", lambda m: "\n" if m[1] == "n" else "\\", unescape(role))


class Tokens:
    """Ids of texts by a tokenizers file that gives every text back (byte-level, say), or without one the bytes of UTF-8."""

    def __init__(self, path: str | None) -> None:
        self.tokenizer, self.kind = None, np.uint8
        if path is not None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the task has one core
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(path)
            self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
            self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.tokenizer is None:
            return [np.frombuffer(t.encode(), np.uint8) for t in texts]
        got = [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if [self.decode(ids) for ids in got] != texts:
            raise ValueError("the tokenizer doesn't give texts back")
        return got

    def decode(self, ids: np.ndarray) -> str:
        if self.tokenizer is None:
            return ids.tobytes().decode()
        return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)


def format_turn(role: str, text: str) -> tuple[str, str, str]:
    """A turn's formatted text: what is before its own text, that, and what is behind it."""
    return f"{START}{_escape_role(role)}\n", escape(text), END


def read_turn(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    role, _, body = formatted[len(START) : -len(END)].partition("\n")
    return _unescape_role(role), unescape(body)


CHAIN = "conv_id long, k long, node binary, parent binary, role string, text string"


def chain(turns: DataFrame) -> DataFrame:
    """CHAIN of each turn; k counts a conversation's turns from 0 in the order of (turn, role, text), and a node is told by its hash.

    Turns stream through a task in order, so a conversation of any length costs one turn's memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, k, node, begun = None, 0, b"", False
        for batch in batches:
            ks, nodes, parents = [], [], []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if not begun or conv != now:
                    now, k, node, begun = conv, 0, b"", True
                h = hashlib.blake2b(node, digest_size=NODE)
                h.update(f"{len(role)}:{role}{text}".encode())
                parents.append(node)
                node = h.digest()
                nodes.append(node)
                ks.append(k)
                k += 1
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(ks, pa.int64()), pa.array(nodes, pa.binary()), pa.array(parents, pa.binary()), batch.column("role"), batch.column("text")], names=["conv_id", "k", "node", "parent", "role", "text"])

    turns = turns.select(F.col("conv_id").cast("long"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # conversations without an id are one
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(run, CHAIN)


def last_nodes(of: DataFrame) -> DataFrame:
    """(conv_id, node) of each conversation's last turn."""
    return of.groupBy("conv_id").agg(F.max(F.struct("k", "node")).alias("last")).select("conv_id", "last.node")


def paths(told: DataFrame) -> DataFrame:
    """(node, path) of the nodes of chain(): the hashes of the first nodes of the segments down to the node's."""
    ends = last_nodes(told).select(F.col("node").alias("parent"), F.lit(True).alias("ends")).distinct()
    children = told.select("parent", "node").distinct().groupBy("parent").agg(F.count("*").alias("n"))
    forks = children.join(ends, "parent", "left").where("n > 1 OR ends OR parent = X''").select("parent", F.lit(True).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = b""
        for batch in batches:
            own = []
            for k, node, first in zip(*(batch.column(c).to_pylist() for c in ("k", "node", "first")), strict=True):
                path = (path if k else b"") + (node if first else b"")
                own.append(path)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(own, pa.binary())], names=["node", "path"])

    marked = salted(told.select("conv_id", "k", "node", "parent"), forks, ["parent"], "conv_id", F.lit(SALTS), "left")
    return marked.repartition("conv_id").sortWithinPartitions("conv_id", "k").select("k", "node", "first").mapInArrow(run, "node binary, path binary").groupBy("node").agg(F.min("path").alias("path"))


EMITTED = "node binary, path binary, depth long, ids binary, n_tokens long, loss_start long, loss_end long, part int, at long"
SPAN = "array<struct<start:bigint,end:bigint>>"


def tree(told: DataFrame, tokenizer: str | None) -> tuple[DataFrame, DataFrame]:
    """The stream of chain()'s nodes, and its segments.

    Stream: node, segment, depth, ids (little-endian, n_tokens of equal width), n_tokens, loss_start, loss_end, stream_start.
    Segments: segment, segment_start, segment_end, position_start, ancestors.
    """
    said = told.groupBy("node").agg(F.min(F.struct("k", "role", "text")).alias("said")).select("node", F.col("said.k").alias("depth"), "said.role", "said.text")
    ordered = said.join(paths(told), "node").repartitionByRange("path", "depth").sortWithinPartitions("path", "depth")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, tokens = TaskContext.get().partitionId(), 0, Tokens(tokenizer)
        for batch in batches:
            roles = batch.column("role").to_pylist()
            parts = [x for role, text in zip(roles, batch.column("text").to_pylist(), strict=True) for x in format_turn(role, text)]
            ids = tokens.encode(parts)
            rows = []
            for i, role in enumerate(roles):
                head, body, tail = ids[3 * i : 3 * i + 3]
                n, trained = len(head) + len(body) + len(tail), role == TRAINED
                rows.append((np.concatenate((head, body, tail)).tobytes(), n, len(head) if trained else 0, len(head) + len(body) if trained else 0, part, at))
                at += n
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "path", "depth")), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[x.split()[0] for x in EMITTED.split(", ")])

    emitted = saved(ordered.select("node", "path", "depth", "role", "text").mapInArrow(emit, EMITTED))
    # a row for each partition: where its stream begins
    parts = emitted.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    begins = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("begin"))
    placed = emitted.join(F.broadcast(begins), "part").withColumn("stream_start", F.col("at") + F.col("begin")).withColumn("segment", F.substring("path", -NODE, NODE))
    # a segment's nodes follow each other in the stream
    segments = placed.groupBy("segment").agg(F.min("path").alias("path"), F.min("stream_start").alias("start"), F.sum("n_tokens").alias("n"))
    segments = saved(segments.select("segment", "path", F.col("start").alias("segment_start"), (F.col("start") + F.col("n")).alias("segment_end")))
    above = segments.where(F.length("path") > NODE).select("segment", F.explode(F.transform(F.sequence(F.lit(0), (F.length("path") / NODE).cast("int") - 2), lambda i: F.substring("path", 1 + i * NODE, F.lit(NODE)))).alias("ancestor"))
    spans = segments.select(F.col("segment").alias("ancestor"), F.struct(F.col("segment_start").alias("start"), F.col("segment_end").alias("end")).alias("span"))
    spans = salted(above, spans, ["ancestor"], "segment", F.lit(SALTS)).groupBy("segment").agg(F.array_sort(F.collect_list("span")).alias("above"), F.sum(F.col("span.end") - F.col("span.start")).alias("before"))
    spans = segments.drop("path").join(spans, "segment", "left")
    spans = spans.select("segment", "segment_start", "segment_end", F.coalesce("before", F.lit(0).cast("long")).alias("position_start"), F.coalesce("above", F.array().cast(SPAN)).alias("ancestors"))
    return placed.select("node", "segment", "depth", "ids", "n_tokens", "loss_start", "loss_end", "stream_start"), saved(spans)


def chat_format(turns: DataFrame, tokenizer: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The stream and the segments of turns (conv_id, turn, role, text), and (conv_id, k, node), the node of each conversation's k-th turn.

    tokenizer is the path, on every executor, of a tokenizers file that gives texts back; without one tokens
    are bytes.  Null roles and texts are empty; equal (conv_id, turn) are ordered by role and text, repeated
    rows are turns of their own; rows without conv_id are one conversation; other columns are not read.
    A node's path has a hash for each segment above it, so its cost follows the forks of the tree, not the
    length of conversations.
    """
    told = saved(chain(turns))
    return *tree(told, tokenizer), told.select("conv_id", "k", "node")


#: Conversations for each copy of a segment that they share, and shared segments that are broadcast at most.
SHARED, BROADCAST_SEGMENTS = 1000, 100_000
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(stream: DataFrame, segments: DataFrame, of: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """What conversations say, read from the stream by their last segments' intervals: READ, one row per conversation.

    Position ids that don't follow each other raise ValueError.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(tokenizer)
        begun, now = False, None
        n = chars = loss = position = 0
        turns = trained = hashlib.sha256()
        done: list[tuple] = []
        for batch in batches:
            for conv, at, ids, low, high in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "position", "ids", "loss_start", "loss_end")), strict=True):
                if not begun or conv != now:
                    if begun:
                        done.append((now, n, turns.hexdigest(), loss, trained.hexdigest(), chars))
                    begun, now, n, chars, loss, position = True, conv, 0, 0, 0, 0
                    turns, trained = hashlib.sha256(), hashlib.sha256()
                if at != position:
                    raise ValueError(f"position {at} where {position} is next")
                own = np.frombuffer(ids, tokens.kind)
                formatted = tokens.decode(own)
                role, text = read_turn(formatted)
                turns.update(f"{role}\n{text}\n".encode())
                masked = unescape(tokens.decode(own[low:high]))
                trained.update(masked.encode())
                n, chars, loss, position = n + 1, chars + len(formatted), loss + len(masked), position + len(own)
            yield _read_rows(done)
            done = []
        if begun:
            yield _read_rows([(now, n, turns.hexdigest(), loss, trained.hexdigest(), chars)])

    own = F.array(F.struct(F.col("segment_start").alias("start"), F.col("segment_end").alias("end")))
    whole = segments.select("segment", F.concat("ancestors", own).alias("spans"))
    last = salted(last_nodes(of), stream.select("node", "segment"), ["node"], "conv_id", F.lit(SALTS)).select("conv_id", "segment")
    asked = salted(last, whole, ["segment"], "conv_id", F.lit(SALTS)).select("conv_id", F.explode("spans").alias("span")).select("conv_id", "span.start", "span.end")
    # an interval begins where a segment does
    begun = segments.select(F.col("segment_start").alias("start"), "segment", "position_start")
    asked = saved(salted(asked, begun, ["start"], "conv_id", F.lit(SALTS)))
    # segments that many conversations share are copied
    hot = saved(asked.groupBy("segment").agg(F.ceil(F.count("*") / SHARED).alias("copies")).where("copies > 1"))
    small = hot.limit(BROADCAST_SEGMENTS + 1).count() <= BROADCAST_SEGMENTS
    copied = lambda df: df.join(F.broadcast(hot) if small else hot, "segment", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    texts = copied(stream.drop("node", "depth", "n_tokens")).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).drop("copies")
    asked = copied(asked).withColumn("copy", F.pmod(F.xxhash64("conv_id"), "copies")).drop("copies")
    said = asked.join(texts, ["segment", "copy"]).where(F.col("stream_start") < F.col("end"))
    said = said.select("conv_id", (F.col("position_start") + F.col("stream_start") - F.col("start")).alias("position"), "ids", "loss_start", "loss_end")
    return said.repartition("conv_id").sortWithinPartitions("conv_id", "position").mapInArrow(digest, READ)


def _read_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    columns = list(zip(*rows, strict=True)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
