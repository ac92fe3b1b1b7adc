"""Chat formatting as prefix trees.

Conversations are cut into pieces of bounded size (nearly always one each) by streaming their turns
in order; every turn is named by a digest of all turns up to it. Ordered by those names, pieces that
share initial turns stand next to each other, in depth-first order, and a streaming pass over each
range emits the trees: shared turns are written once in all, each node carries its position (continuing its
parent's) and the intervals of its ancestors, which are all that it may attend to.

Trees are cut into rows of bounded size, between nodes. What is above a cut is not written again: a node
whose parent stands in another row names it (`above`), its position goes on from there, and the row lists the path above
its first nodes (`entry`), for which with_intervals() adds the rows and intervals where these turns stand. So do the
later pieces of a very long conversation, which know the last turn of the piece before. No group is ever collected: a first
turn that a third of all conversations share is spread over as many rows and partitions as its size asks for; a
partition goes on from the end of the one before, of which it is told the path that both share.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import bound_batches, checkpointed, table
from brindle.llm.packing import Encoder, encoder_of, tokenizer_path

#: The strings that have a meaning in a template; inside texts they are escaped.
START, END = "<|im_start|>", "<|im_end|>"
CONTROL = (START, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LOSS_ROLE = "assistant"
#: Bounds of a piece of a conversation, and of a row of a tree.
PIECE_TURNS, PIECE_CHARS = 512, 1 << 20
TREE_TOKENS, TREE_CONVERSATIONS = 16_384, 4096

_CONTROL = re.compile("|".join(re.escape(c) for c in sorted(CONTROL, key=len, reverse=True)))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.DOTALL)


def escape(text: str) -> str:
    """No control string is left; backslashes are doubled, so that unescape() is exact."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def parts(role: str, text: str) -> tuple[str, str, str]:
    """Head, body and tail of a formatted turn; the head is one line."""
    name = escape(role).replace("\n", "\\n")
    return f"{START}{name}\n", escape(text), f"{END}\n"


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of formatted turns."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def chain(before: bytes, role: str, text: str) -> bytes:
    """Name of a turn: digest of its predecessors' name, role and text."""
    h = hashlib.blake2b(before, digest_size=16)
    for part in (role.encode(), text.encode()):
        h.update(len(part).to_bytes(8, "little"))
        h.update(part)
    return h.digest()


def coded(encoder: Encoder, role: str, text: str) -> tuple[array, int, int]:
    """Ids of a formatted turn, and the interval of them under the loss."""
    head, body, tail = (array("I", encoder.ids(x)) for x in parts(role, text))
    bounds = (len(head), len(head) + len(body)) if role == LOSS_ROLE else (0, 0)
    return head + body + tail, *bounds


def pieces(turns: DataFrame, path: str, piece_turns: int = PIECE_TURNS) -> DataFrame:
    """conv_id, piece, path (names of the turns), roles, texts, above (name of the turn before, null in a first piece)
    and begin (position of the first token); null roles and texts are empty.

    Turns are ordered by turn (null first), then role and text, so repeated rows and ties are kept, in a
    defined order. Rows without conv_id form one conversation.
    """
    rows = turns.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    kind = rows.schema["conv_id"].dataType.simpleString()
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    tokenizer = path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        now, piece, path, roles, texts, size, name = object(), 0, [], [], [], 0, b""
        above, begin = None, 0

        def done(last: bool = True) -> None:
            nonlocal piece, path, roles, texts, size, held, above, begin
            if path:
                out.append((now, piece, path, roles, texts, above, begin))
                held += size
                if last:
                    above, begin = None, 0
                else:  # only a conversation that goes on needs its tokens counted here
                    above, begin = path[-1], begin + sum(len(coded(encoder_of(tokenizer), *t)[0]) for t in zip(roles, texts))
                piece, path, roles, texts, size = piece + 1, [], [], [], 0

        def batch_of(schema_type: pa.DataType) -> pa.RecordBatch:
            nonlocal held
            columns = [pa.array([r[0] for r in out], schema_type), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.list_(pa.binary()))]
            columns += [pa.array([r[k] for r in out], pa.list_(pa.string())) for k in (3, 4)]
            columns += [pa.array([r[5] for r in out], pa.binary()), pa.array([r[6] for r in out], pa.int64())]
            out.clear()
            held = 0
            return pa.RecordBatch.from_arrays(columns, names=["conv_id", "piece", "path", "roles", "texts", "above", "begin"])

        conv_type = None
        for batch in batches:
            conv_type = batch.schema.field("conv_id").type
            for conv, role, text in zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if conv != now:
                    done()
                    now, piece, name = conv, 0, b""
                elif len(path) >= piece_turns or size >= PIECE_CHARS:
                    done(last=False)
                name = chain(name, role, text)
                path.append(name)
                roles.append(role)
                texts.append(text)
                size += len(text) + 64
                if held >= PIECE_CHARS or len(out) >= 1000:
                    yield batch_of(conv_type)
        done()
        if out:
            yield batch_of(conv_type)

    return ordered.mapInArrow(run, f"conv_id {kind}, piece int, path array<binary>, roles array<string>, texts array<string>, above binary, begin bigint")


class Tree:
    """A row: nodes of a tree in depth-first order, and the tokens of each, emitted once.

    `stack` is the path from the root to the latest node, as (name, number in this row or -1, position of its end);
    it goes on from row to row. `entry` is the part of the path at the row's start that its nodes refer to.
    """

    def __init__(self, stack: list[tuple[bytes, int, int]]):
        self.ids, self.positions = array("I"), array("q")
        self.nodes: list[dict] = []
        self.stack = [(name, -1, end) for name, _, end in stack]
        self.leaves: list[dict] = []
        self.before, self.used = [name for name, _, _ in stack], 0

    @property
    def entry(self) -> list[bytes]:
        return self.before[: self.used]

    def shared(self, path: list[bytes]) -> int:
        n = 0
        for (name, _, _), other in zip(self.stack, path):
            if name != other:
                break
            n += 1
        return n

    def add(self, piece: dict, new: list[tuple[array, int, int]]) -> None:
        """`new`: of each turn beyond the shared ones, ids and the place of the loss-bearing ones."""
        path = piece["path"]
        n_shared = len(path) - len(new)
        del self.stack[n_shared:]
        for name, (ids, first, last) in zip(path[n_shared:], new, strict=True):
            above, parent, begin = self.stack[-1] if self.stack else (piece["above"], -1, piece["begin"])
            start = len(self.ids)
            intervals: list[dict] = []
            if self.stack and parent < 0:
                self.used = max(self.used, len(self.stack))
            if parent >= 0:
                over = self.nodes[parent]
                above, intervals = over["above"], [dict(x) for x in over["ancestors"]]
                if intervals and intervals[-1]["end"] == over["start"]:
                    intervals[-1]["end"] = over["end"]
                else:
                    intervals.append({"start": over["start"], "end": over["end"]})
            self.ids.extend(ids)
            self.positions.extend(range(begin, begin + len(ids)))
            self.nodes.append({"name": name, "above": above, "start": start, "end": len(self.ids), "parent": parent, "position": begin, "loss_start": start + first, "loss_end": start + last, "ancestors": intervals})
            self.stack.append((name, len(self.nodes) - 1, begin + len(ids)))
        if self.stack[-1][1] < 0:
            self.used = max(self.used, len(self.stack))
        self.leaves.append({"conv_id": piece["conv_id"], "piece": piece["piece"], "turns": len(path), "name": path[-1], "leaf": self.stack[-1][1]})


TREE = (
    "tree_id bigint, ids array<int>, positions array<bigint>, "
    "nodes array<struct<name:binary,above:binary,start:int,end:int,parent:int,position:bigint,loss_start:int,loss_end:int,ancestors:array<struct<start:int,end:int>>>>, "
    "leaves array<struct<conv_id:{id},piece:int,turns:int,name:binary,leaf:int>>, entry array<binary>"
)
#: Characters that the paths shared at the borders of partitions may have in all; beyond, the lower turns of long ones are written on both sides.
CARRIED = 64 << 20
#: The bits of a tree_id below its stream (the range it was made from); in these, rows of a stream are numbered.
ROW_BITS = 33


def border_paths(ordered: DataFrame, path: str) -> dict[int, list[tuple[bytes, int, int]]]:
    """For each partition of the ordered pieces the path that its first piece shares with the last one before it: names, and where each turn ends.

    Two rows per partition are looked at, and no others leave the JVM.
    """
    marked = ordered.withColumn("pid", F.spark_partition_id()).withColumn("n", F.monotonically_increasing_id())
    ends = marked.groupBy("pid").agg(F.min("n").alias("first"), F.max("n").alias("last")).collect()  # a row per partition
    if len(ends) < 2:
        return {}
    at = ordered.sparkSession.createDataFrame([(n,) for n in sorted({x for r in ends for x in (r.first, r.last)})], "n bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in batches:
            rows = batch.to_pylist()
            stops = []
            for r in rows:
                here, stop = r["begin"], []
                for t in zip(r["roles"], r["texts"]):
                    here += len(coded(encoder, *t)[0])
                    stop.append(here)
                stops.append(stop)
            sizes = [[len(r) + len(t) + 64 for r, t in zip(x["roles"], x["texts"])] for x in rows]
            columns = [batch.column("n"), batch.column("path"), pa.array(stops, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["n", "path", "stops", "sizes"])

    few = marked.join(F.broadcast(at), "n").select("n", "path", "roles", "texts", "begin")  # two rows per partition
    found = {r.n: (r.path, r.stops, r.sizes) for r in few.mapInArrow(run, "n bigint, path array<binary>, stops array<bigint>, sizes array<bigint>").toLocalIterator()}
    ends.sort(key=lambda r: r.pid)
    most, out = CARRIED // len(ends), {}
    for before, now in zip(ends, ends[1:]):
        (left, stops, sizes), (right, _, _) = found[before.last], found[now.first]
        shared, size = [], 0
        for name, other, stop, more in zip(left, right, stops, sizes):
            size += more
            if name != other or size > most:
                break
            shared.append((bytes(name), -1, stop))
        if shared:
            out[now.pid] = shared
    return out


def with_intervals(trees: DataFrame) -> DataFrame:
    """The rows with `entry` as array of (name, tree_id, start, end): the tokens of the path above the row, from the root on. A node
    whose `above` is the k-th of these attends to the first k of them, besides its ancestors in its own row."""
    nodes = trees.select("tree_id", F.explode("nodes").alias("n")).select(F.col("n.name").alias("name"), F.col("tree_id").alias("at"), F.col("n.start").alias("start"), F.col("n.end").alias("end"))
    asked = trees.select("tree_id", F.posexplode("entry").alias("k", "name"))
    found = asked.join(nodes, "name").groupBy("tree_id").agg(F.array_sort(F.collect_list(F.struct("k", "name", F.col("at").alias("tree_id"), "start", "end"))).alias("_far"))
    short = F.transform("_far", lambda x: F.struct(x["name"].alias("name"), x["tree_id"].alias("tree_id"), x["start"].alias("start"), x["end"].alias("end")))
    none = F.array().cast("array<struct<name:binary,tree_id:bigint,start:int,end:int>>")
    return trees.join(found, "tree_id", "left").withColumn("entry", F.coalesce(short, none)).drop("_far")


def chat_trees(turns: DataFrame, path: str | None = None, tree_tokens: int = TREE_TOKENS, piece_turns: int = PIECE_TURNS) -> DataFrame:
    """Rows of prefix trees: token ids with their positions, nodes (a turn each: its name, token interval, parent,
    position of its first token, interval under the loss, intervals of its ancestors in this row, and `above`, the name
    of the nearest ancestor in another row) and leaves (a conversation's piece, its number of turns, its last turn).

    A token attends to the earlier ones of its own node, to its ancestors' intervals and, where there is an `above`,
    to that node and all that it attends to: the row's `entry` names these from the root on (with_intervals() adds where they
    stand), but for the earlier pieces of a conversation that is longer than one, of which the first node's `above` names the last turn. A turn that
    conversations share is written once, whatever the number of partitions. Positions count from the conversation's first token over all of these. A
    leaf or parent of -1 stands in another row (or, without `above`, nowhere). A row holds `tree_tokens` tokens, or the one
    piece that is longer. Rows without conv_id form one conversation; other columns are not read. An empty table gives no trees.
    """
    path = path or tokenizer_path()
    bound_batches(turns.sparkSession, rows=500, size=4 << 20)
    found = pieces(turns, path, piece_turns)
    kind = found.schema["conv_id"].dataType.simpleString()
    keys = ["path", "conv_id", "piece"]
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = checkpointed(found.repartitionByRange(n, *keys).sortWithinPartitions(*keys))  # for two passes over the same partitions
    borders = border_paths(ordered, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        pid = TaskContext.get().partitionId()
        base, made, tree, leaf_type = pid << ROW_BITS, 0, Tree(borders.get(pid, [])), None
        span = [("start", pa.int32()), ("end", pa.int32())]
        names = [("name", pa.binary()), ("above", pa.binary())]
        node = pa.struct([*names, *span, ("parent", pa.int32()), ("position", pa.int64()), ("loss_start", pa.int32()), ("loss_end", pa.int32()), ("ancestors", pa.list_(pa.struct(span)))])

        def row() -> pa.RecordBatch:
            leaf = pa.struct([("conv_id", leaf_type), ("piece", pa.int32()), ("turns", pa.int32()), ("name", pa.binary()), ("leaf", pa.int32())])
            columns = [pa.array([base + made], pa.int64())]
            columns += [pa.array([x], t) for x, t in ((tree.ids, pa.list_(pa.int32())), (tree.positions, pa.list_(pa.int64())), (tree.nodes, pa.list_(node)), (tree.leaves, pa.list_(leaf)), (tree.entry, pa.list_(pa.binary())))]
            return pa.RecordBatch.from_arrays(columns, names=["tree_id", "ids", "positions", "nodes", "leaves", "entry"])

        for batch in batches:
            leaf_type = batch.schema.field("conv_id").type
            for r in batch.to_pylist():
                new = [coded(encoder, *t) for t in list(zip(r["roles"], r["texts"]))[tree.shared(r["path"]) :]]
                if tree.leaves and (len(tree.leaves) >= TREE_CONVERSATIONS or len(tree.ids) + sum(len(c[0]) for c in new) > tree_tokens):
                    yield row()
                    tree, made = Tree(tree.stack), made + 1
                tree.add(r, new)
        if tree.leaves:
            yield row()

    return ordered.mapInArrow(run, TREE.format(id=kind))


def border_turns(trees: DataFrame) -> DataFrame:
    """name, ids, loss_start and loss_end of the turns above the first row of each stream, which stand in other streams. Their number and
    length are bounded by what chat_trees carries over borders."""
    first = trees.groupBy(F.shiftright("tree_id", ROW_BITS).alias("stream")).agg(F.min_by("entry", "tree_id").alias("entry"))
    wanted = first.select(F.explode("entry").alias("name")).distinct()
    nodes = trees.select("tree_id", F.explode("nodes").alias("n")).select("tree_id", F.col("n.name").alias("name"), "n.start", "n.end", "n.loss_start", "n.loss_end")
    here = nodes.join(wanted, "name", "left_semi").dropDuplicates(["name"])
    rows = trees.select("tree_id", "ids").join(F.broadcast(here), "tree_id")
    return rows.select("name", F.slice("ids", F.col("start") + 1, F.col("end") - F.col("start")).alias("ids"), (F.col("loss_start") - F.col("start")).alias("loss_start"), (F.col("loss_end") - F.col("start")).alias("loss_end"))


def read_back(trees: DataFrame, path: str | None = None, in_order: bool = False) -> DataFrame:
    """conv_id, piece, n_turns, turns ("role\\ntext\\n" of each), loss (all text under the loss mask, unescaped)
    and formatted_chars, from the trees' tokens, nodes and masks alone. `trees` is read more than once: give a stored or checkpointed table.

    The rows of a stream are read one after the other: what is above a row is the end of the path before it, and what is above
    a stream are turns of other streams, which are looked up first. `in_order` tells that they come straight from chat_trees; else they
    are brought together and sorted first.
    """
    path = path or tokenizer_path()
    kind = trees.schema["leaves"].dataType.elementType["conv_id"].dataType.simpleString()
    bound_batches(trees.sparkSession, rows=64, size=4 << 20)
    carried = {bytes(r.name): (r.ids, r.loss_start, r.loss_end) for r in border_turns(trees).toLocalIterator()}
    if not in_order:
        trees = trees.repartition(F.shiftright("tree_id", ROW_BITS)).sortWithinPartitions("tree_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        lib = Tokenizer.from_file(path)
        decode = lambda ids: lib.decode(ids, skip_special_tokens=False)
        names = ["conv_id", "piece", "n_turns", "turns", "loss", "formatted_chars"]
        kinds = (None, pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64())
        now: list[tuple[bytes, str, str]] = []  # the path to the latest node: name, formatted, text under the loss
        depth: dict[bytes, int] = {}
        stream = None

        def back_to(name: bytes | None) -> None:
            keep = depth.get(name, 0)
            for gone, _, _ in now[keep:]:
                del depth[gone]
            del now[keep:]

        def add(name: bytes, ids: list[int], first: int, last: int) -> None:
            now.append((name, decode(ids), unescape(decode(ids[first:last]))))
            depth[name] = len(now)

        def read(leaf: dict) -> tuple:
            own = now[len(now) - leaf["turns"] :]
            formatted = "".join(x[1] for x in own)
            turns = parse(formatted)
            return leaf["conv_id"], leaf["piece"], len(turns), "".join(f"{r}\n{t}\n" for r, t in turns), "".join(x[2] for x in own), len(formatted)

        for batch in batches:
            kinds = (batch.schema.field("leaves").type.value_type.field("conv_id").type, *kinds[1:])
            for tree in batch.to_pylist():
                ids, nodes, rows, ended = tree["ids"], tree["nodes"], [], {}
                if tree["tree_id"] >> ROW_BITS != stream:
                    stream = tree["tree_id"] >> ROW_BITS
                    back_to(None)
                    for name in tree["entry"]:
                        add(name, *carried[name])
                for leaf in tree["leaves"]:
                    ended.setdefault(leaf["leaf"], []).append(leaf)
                for leaf in ended.get(-1, []):
                    back_to(leaf["name"])
                    rows.append(read(leaf))
                for k, node in enumerate(nodes):
                    back_to(nodes[node["parent"]]["name"] if node["parent"] >= 0 else node["above"])
                    add(node["name"], ids[node["start"] : node["end"]], node["loss_start"] - node["start"], node["loss_end"] - node["start"])
                    rows.extend(map(read, ended.get(k, [])))
                for at in range(0, len(rows), 256):
                    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows[at : at + 256]], t) for k, t in enumerate(kinds)], names=names)

    return trees.mapInArrow(run, f"conv_id {kind}, piece int, n_turns bigint, turns string, loss string, formatted_chars bigint")


def digests(read: DataFrame) -> DataFrame:
    """One row per conversation: its pieces are hashed in order, as a stream."""
    kind = read.schema["conv_id"].dataType.simpleString()
    ordered = read.repartition("conv_id").sortWithinPartitions("conv_id", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, conv_type = object(), None, None

        def batch_of(rows: list) -> pa.RecordBatch:
            kinds = (conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

        def done() -> tuple:
            return now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

        for batch in batches:
            conv_type, rows = batch.schema.field("conv_id").type, []
            for r in batch.to_pylist():
                if r["conv_id"] != now or state is None:
                    if state:
                        rows.append(done())
                    now, state = r["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += r["n_turns"]
                state[1].update(r["turns"].encode())
                state[2] += len(r["loss"])
                state[3].update(r["loss"].encode())
                state[4] += r["formatted_chars"]
            if rows:
                yield batch_of(rows)
        if state:
            yield batch_of([done()])

    return ordered.mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], turns.schema)
    return digests(read_back(checkpointed(chat_trees(turns.unionByName(added))), in_order=True))


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(replace(role, '\', '\\')) + length(replace(text, '\', '\\'))
  + len(regexp_extract_all(text, '<\|im_start\|>|<\|im_end\|>|</?s>|\[/?INST\]|<</?SYS>>')) + length('<|im_start|>' || '<|im_end|>') + 2 AS n FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
