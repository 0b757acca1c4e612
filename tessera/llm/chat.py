"""Chat formatting in budgeted windows, with a loss mask.

A turn is written as ``<|im_start|>role``, a newline, its text, ``<|im_end|>`` and a newline. Control
strings inside texts and roles get a backslash after their first character, one more than they have,
so that no text can open or close a turn and every text can be read back.

A conversation may be longer than the budget. The prefix sums of its turns' tokens cut it into
windows at turns: those that begin in one stretch of ``room`` tokens share a window; the turn that
crosses the stretch's end gets a window of its own where both don't fit. ``room`` is the budget less
the system turn and the history, a quarter of the budget at least. A window repeats the system turn
(the first turn, if its role is ``system``) and up to ``HISTORY`` turns before its first one, as far
as they have ``HISTORY_TOKENS`` tokens together. The loss mask covers the texts of assistant turns
where they are new; repeated ones are context. A turn beyond the room stands alone and whole: texts
are never cut, such a window exceeds the budget.

No conversation is gathered in one task: turns are sorted in ranges, sums and ordinals of a range are
moved by those of the ranges before it, and windows are put together by (conversation, window). Only
``read_back`` reads a conversation's windows in one stream, in constant memory, because its digests
are over the whole of it.

Defined results: a null text or role is empty. Null conversation ids form one conversation. Rows of
equal turn follow each other by role, then by a hash of the text; null turns come first; repeated
rows are turns of their own. Columns other than the four named are ignored; an empty table has no
windows.
"""
import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import vocab
from .common import keep, whole_text

BUDGET, HISTORY, HISTORY_TOKENS = 2048, 2, 256
START, END = "<|im_start|>", "<|im_end|>"
# Control strings of the template, of the vocabulary and of two common other templates.
RESTS = r"\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\]"
PLAIN, ESCAPED = rf"([<\[])(\\*+)({RESTS})", re.compile(rf"([<\[])\\(\\*+)({RESTS})")
TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.DOTALL)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, PLAIN, r"$1\\$2$3")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def count_tokens(text: Column, path: str) -> Column:
    @F.pandas_udf("bigint")
    def count(texts):
        return texts.map(lambda t: len(vocab.encode_ids(t, path))).astype("int64")
    return count(text)


def written_turns(turns: DataFrame, path: str) -> DataFrame:
    """Kept table of one row per turn: its conversation key, sort columns, written form and tokens."""
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    role, text = whole_text("role"), whole_text("text")
    rows = turns.select(key.alias("conv"), F.col("turn"), role.alias("role"), F.xxhash64(text).alias("hash"), escape_role(role).alias("_role"), escape(text).alias("_text"))
    part = F.concat(F.lit(START), "_role", F.lit("\n"), "_text", F.lit(END + "\n"))
    rows = rows.select("conv", "turn", "role", "hash", part.alias("part"), (F.length("_role") + len(START) + 1).alias("head"), F.length("_text").alias("body"))
    return keep(rows.withColumn("tokens", count_tokens(F.col("part"), path)).withColumn("id", F.monotonically_increasing_id()))


def placed(written: DataFrame) -> DataFrame:
    """(id, conv, at, before, tokens, system, system_tokens): ordinal and tokens before each turn, the system turn's not counted.

    The sort is cut into ranges. Only a conversation that goes on in a later range has an offset: at
    most one row for each range.
    """
    order = ["conv", "turn", "role", "hash", "id"]
    rows = written.select(*order, "tokens").repartitionByRange(*order).sortWithinPartitions(*order)
    rows = keep(rows.withColumn("place", F.monotonically_increasing_id())).withColumn("range", F.shiftright("place", 33))
    inside = W.partitionBy("conv", "range").orderBy("place")
    earlier = inside.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.select("id", "conv", "range", "role", "tokens", (F.row_number().over(inside) - 1).alias("_at"), F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("_sum"))
    ranges = rows.groupBy("conv", "range").agg(F.count("*").alias("_n"), F.sum("tokens").alias("_t"))
    past = W.partitionBy("conv").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    moved = ranges.select("conv", "range", F.sum("_n").over(past).alias("_n"), F.sum("_t").over(past).alias("_t")).filter("_n > 0")
    rows = rows.join(keep(moved), ["conv", "range"], "left")
    rows = rows.select("id", "conv", "tokens", (F.col("_at") + F.coalesce("_n", F.lit(0))).alias("at"), (F.col("_sum") + F.coalesce("_t", F.lit(0))).alias("before"), "role")
    rows = keep(rows.withColumn("system", (F.col("at") == 0) & (F.col("role") == "system")).drop("role"))
    systems = rows.filter("system").select("conv", F.col("tokens").alias("system_tokens"))
    rows = rows.join(systems, "conv", "left").withColumn("system_tokens", F.coalesce("system_tokens", F.lit(0)))
    return rows.withColumn("before", F.greatest(F.col("before") - F.col("system_tokens"), F.lit(0)))


def with_windows(rows: DataFrame, budget: int, history_tokens: int) -> DataFrame:
    """Adds ``window``, rising inside a conversation. Turns that begin in one stretch are bounded by its tokens."""
    room = F.greatest(F.lit(budget - history_tokens) - F.col("system_tokens"), F.lit(max(1, budget // 4)))
    rows = rows.withColumn("_room", room).withColumn("_stretch", F.floor(F.col("before") / F.col("_room")))
    own = F.when(F.col("system"), 0).otherwise(F.col("tokens"))
    begin = F.min("before").over(W.partitionBy("conv", "_stretch"))
    alone = (F.col("before") > begin) & (F.col("before") + own - begin > F.col("_room"))
    return rows.withColumn("window", (2 * F.col("_stretch") + F.when(alone, 1).otherwise(0)).cast("bigint")).drop("_room", "_stretch")


def members(rows: DataFrame, history: int, history_tokens: int) -> DataFrame:
    """(id, conv, window, at, new): the turns of each window, new ones and repeated ones.

    A system turn keeps ordinal 0 and a repeated turn its own, so ``at`` orders a window.
    """
    new = rows.select("id", "conv", "window", "at", F.lit(True).alias("new"))
    windows = rows.groupBy("conv", "window").agg(F.min("at").alias("_from"), F.max("system_tokens").alias("_s"))
    later = windows.filter(F.col("_from") > 0)
    system = later.join(rows.filter("system").select("id", "conv"), "conv").select("id", "conv", "window", F.lit(0).cast("bigint").alias("at"), F.lit(False).alias("new"))
    wanted = later.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(max(1, history))))).filter(F.col("_k") <= history).withColumn("at", (F.col("_from") - F.col("_k")).cast("bigint"))
    wanted = wanted.filter(F.col("at") >= F.when(F.col("_s") > 0, 1).otherwise(0)).select("conv", "window", "at")
    found = wanted.join(rows.select("id", "conv", "at", "tokens"), ["conv", "at"])
    total = F.sum("tokens").over(W.partitionBy("conv", "window").orderBy(F.desc("at")))
    past = found.withColumn("_t", total).filter(F.col("_t") <= history_tokens).select("id", "conv", "window", "at", F.lit(False).alias("new"))
    return new.unionByName(system).unionByName(past)


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, history_tokens: int = HISTORY_TOKENS, path: str | None = None) -> DataFrame:
    """(conv, conv_id, window, first_turn, n_new, n_repeated, n_tokens, text, loss) of ``turns(conv_id, turn, role, text)``.

    ``loss`` lists begin and end, in code points of ``text``, of what is trained on. Repeated turns stand
    before new ones.
    """
    written = written_turns(turns, path or vocab.default_path())
    rows = keep(with_windows(placed(written), budget, history_tokens))
    parts = written.select("id", "role", "part", "head", "body", "tokens").join(members(rows, history, history_tokens), "id")
    item = F.struct("at", "new", "part", "tokens", "head", "body", (F.col("new") & (F.col("role") == "assistant")).alias("loss"))
    windows = parts.groupBy("conv", "window").agg(F.array_sort(F.collect_list(item)).alias("_p"))

    def span(state: Column, x: Column) -> Column:
        begin = state["at"] + x["head"]
        own = F.struct(begin.alias("begin"), (begin + x["body"]).alias("end"))
        return F.struct((state["at"] + F.length(x["part"])).alias("at"), F.when(x["loss"], F.array_append(state["loss"], own)).otherwise(state["loss"]).alias("loss"))

    none = F.array().cast("array<struct<begin:int,end:int>>")
    folded = F.aggregate("_p", F.struct(F.lit(0).alias("at"), none.alias("loss")), span)
    fresh = F.filter("_p", lambda x: x["new"])
    conv_id = F.when(F.col("conv") != "", F.substr("conv", F.lit(2))).cast(turns.schema["conv_id"].dataType)
    return windows.select(
        "conv", conv_id.alias("conv_id"), "window", fresh[0]["at"].alias("first_turn"), F.size(fresh).alias("n_new"), (F.size("_p") - F.size(fresh)).alias("n_repeated"),
        F.aggregate("_p", F.lit(0).cast("bigint"), lambda n, x: n + x["tokens"]).alias("n_tokens"), F.array_join(F.transform("_p", lambda x: x["part"]), "").alias("text"), folded["loss"].alias("loss"))


def read_back(windows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), parsed from the windows' texts and masks alone."""
    names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        now, done = None, []

        def close():
            done.append((now, n, turns.hexdigest(), chars, loss.hexdigest(), size))

        for batch in batches:
            for conv, repeated, text, mask in zip(*(batch.column(c).to_pylist() for c in ("conv", "n_repeated", "text", "loss"))):
                if conv != now:
                    if now is not None:
                        close()
                    now, n, chars, size, turns, loss = conv, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                size += len(text)
                for k, m in enumerate(TURN.finditer(text)):
                    if k >= repeated:
                        n += 1
                        turns.update(f"{unescape_role(m[1])}\n{unescape(m[2])}\n".encode())
                for s in mask:
                    said = unescape(text[s["begin"]:s["end"]])
                    chars += len(said)
                    loss.update(said.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=names)
                done.clear()
        if now is not None:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=names)

    rows = windows.select("conv", "window", "n_repeated", "text", "loss").repartition("conv").sortWithinPartitions("conv", "window")
    read = rows.mapInArrow(run, "conv string, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
    conv_id = F.when(F.col("conv") != "", F.substr("conv", F.lit(2))).cast(windows.schema["conv_id"].dataType)
    return read.select(conv_id.alias("conv_id"), *names[1:])
