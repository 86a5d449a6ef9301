r"""Operator 9, chat formatting: reply trees to one training text per conversation.

Messages form trees (node, parent). Self-joins that double their reach (a message's ancestor at distance 2^k, joined with
that ancestor's) give every message its depth and its path's score in log2(depth) rounds; messages without replies are
the leaves, i.e. root-to-leaf paths. Each tree's paths are ranked by score (then depth, then node); the messages of the
best ones are marked by walking the doubled links back, and each path is formatted as one conversation.

Template: ``<s>`` opens a conversation; a user turn is ``[INST] text [/INST]``, an assistant turn ``text</s>``, any other
``[ROLE]role[/ROLE]text[/ROLE]``. Inside roles and texts a backslash goes before each backslash and each control string,
and is taken away again on reading, so every text comes back. The loss mask is a list of [start, end) code points.

Defined cases: a null text or role is ''; null conv_id is a conversation, an empty one another; rows that agree in turn are ordered by role and
text hash; null turns come first; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: The control strings of the template.
CONTROLS = r"</?s>|\[/?INST\]|\[/?ROLE\]"
_ESCAPE = rf"(\\|{CONTROLS})"
_TOKEN = re.compile(rf"\\(?:\\|{CONTROLS})|({CONTROLS})")
_UNESCAPE = re.compile(rf"\\(\\|{CONTROLS})")


def escape(c):
    return F.regexp_replace(F.coalesce(c, F.lit("")), _ESCAPE, r"\\$1")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation."""
    turns, at, role, open_ = [], 0, None, ""
    for m in _TOKEN.finditer(formatted):
        if not (c := m[1]):
            continue
        part = formatted[at : m.start()]
        at = m.end()
        if c in ("<s>", "[INST]", "[ROLE]"):
            open_, role = c, None
        elif c == "</s>":
            turns.append(("assistant", unescape(part)))
        elif c == "[/INST]":
            turns.append(("user", unescape(part[1:-1])))
        elif role is None:
            role = unescape(part)
        else:
            turns.append((role, unescape(part)))
            role = None
    return turns


def as_tree(rows: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> messages(conv, node, parent, conv_id, role, text, score): each replies to the one before.

    conv is '' for a null conv_id and else '=' with the id, so that an empty id is another conversation than none.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", F.xxhash64("text"))
    df = rows.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("long"))
    return df.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"),
        "conv_id", "role", "text", F.lit(1.0).alias("score"),
    )


def best_paths(messages: DataFrame, scratch: Scratch, paths: int = 1) -> DataFrame:
    """messages(conv, node, parent, score) -> (conv, leaf, node, depth) on the best root-to-leaf paths, so many of each tree; leaf names the path.

    A conversation may hold several trees. A parent that isn't among the messages ends a path like a missing one.
    """
    links = scratch.write(messages.select("conv", "node", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.col("score").cast("double").alias("score"), F.when(F.col("parent").isNull(), F.col("node")).alias("root")))
    rounds = [links]
    while not links.where("up is not null").isEmpty():
        far = links.select("conv", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"), F.col("score").alias("s2"), F.col("root").alias("r2"))
        links = scratch.write(  # only messages whose path isn't at its root yet go on
            links.where("up is null").union(links.where("up is not null").join(far, ["conv", "up"], "left").select(
                "conv", "node", F.col("up2").alias("up"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"), (F.col("score") + F.coalesce("s2", F.lit(0.0))).alias("score"), F.coalesce("r2", "up").alias("root")
            ))
        )
        rounds.append(links)
    parents = messages.where("parent is not null").select("conv", F.col("parent").alias("node")).distinct()
    leaves = links.join(parents, ["conv", "node"], "left_anti")
    if paths == 1:
        best = leaves.groupBy("conv", "root").agg(F.max(F.struct("score", "depth", (-F.col("node")).alias("node"))).alias("b")).select("conv", (-F.col("b.node")).alias("leaf"))
    else:
        rank = Window.partitionBy("conv", "root").orderBy(F.desc("score"), F.desc("depth"), "node")
        best = leaves.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= paths).select("conv", F.col("node").alias("leaf"))
    marked = scratch.write(best.withColumn("node", F.col("leaf")))
    for r in reversed(rounds[:-1]):
        up = marked.join(r.where("up is not null"), ["conv", "node"]).select("conv", "leaf", F.col("up").alias("node"))
        marked = scratch.write(marked.union(up))
    return marked.join(links.select("conv", "node", "depth"), ["conv", "node"])


def format_conversations(messages: DataFrame, scratch: Scratch | None = None, paths: int = 1) -> DataFrame:
    """messages -> (conv_id, n_turns, formatted, loss array<struct<start, end>>), the loss on assistant texts; a row for each chosen path."""
    scratch = scratch or Scratch(messages.sparkSession)
    path = best_paths(messages, scratch, paths)
    role, text = F.coalesce("role", F.lit("")), escape(F.col("text"))
    piece = F.when(role == "user", F.concat(F.lit("[INST] "), text, F.lit(" [/INST]"))).when(role == "assistant", F.concat(text, F.lit("</s>"))).otherwise(F.concat(F.lit("[ROLE]"), escape(F.col("role")), F.lit("[/ROLE]"), text, F.lit("[/ROLE]")))
    turns = messages.join(path, ["conv", "node"]).select("conv", "leaf", "conv_id", "depth", piece.alias("piece"), F.when(role == "assistant", F.length(text)).alias("loss"))
    grouped = turns.groupBy("conv", "leaf", "conv_id").agg(F.array_sort(F.collect_list(F.struct("depth", "piece", "loss"))).alias("t"))
    offsets = F.aggregate("t", F.struct(F.lit(3).alias("at"), F.lit("").alias("spans")), lambda acc, x: F.struct((acc["at"] + F.length(x["piece"])).alias("at"), F.when(x["loss"].isNotNull(), F.concat(acc["spans"], acc["at"].cast("string"), F.lit(":"), (acc["at"] + x["loss"]).cast("string"), F.lit(";"))).otherwise(acc["spans"]).alias("spans")))["spans"]
    spans = F.transform(F.filter(F.split(offsets, ";"), lambda s: s != ""), lambda s: F.struct(F.split(s, ":")[0].cast("int").alias("start"), F.split(s, ":")[1].cast("int").alias("end")))
    return grouped.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.concat(F.lit("<s>"), F.array_join(F.transform("t", lambda x: x["piece"]), "")).alias("formatted"), spans.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss) -> digests of what a reader of the formatted texts sees."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, spans in zip(b.column(1), b.column(2), strict=True):
                text = text.as_py()
                turns = parse(text)
                whole = hashlib.sha256()
                for role, said in turns:
                    whole.update(f"{role}\n{said}\n".encode())
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans.as_py())
                out.append((len(turns), whole.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            columns = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = dict(formatted.dtypes)["conv_id"]
    return formatted.select("conv_id", "formatted", "loss").mapInArrow(digest, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
