r"""Chat formatting in budgeted windows, with DataFrame functions only.

A conversation is cut into windows of whole turns. Prefix sums of turn tokens
choose each window's span: a window takes turns while their tokens fit the
budget, a single turn over the budget gets a window of its own. A later window
starts with the system turn and repeats up to `history` earlier turns, as far as
they fit; what is repeated is never under the loss mask.

Template, for a turn: ``### <role>:\n<text>\n</turn>\n``. In texts a backslash
is put before every backslash, before each ``#`` that starts ``###`` and before
``</turn>``; in roles ``% : < #`` and line breaks are written as ``%xx``. Both
are undone exactly by the functions below.

Defined results: null role or text counts as empty; turns sort by turn (nulls
first), then role and text, and repeated rows stay repeated turns; a null
conv_id is a conversation of its own; extra columns are ignored; an empty table
gives no window. A conversation is one row here, as its digest is one hash over
all its turns, so a conversation has to fit a row (2 GB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

END = "\n</turn>\n"
#: Characters of a role that are written as %xx; the percent sign comes first.
ROLE_ESCAPES = (("%", "%25"), (":", "%3A"), ("<", "%3C"), ("#", "%23"), ("\n", "%0A"))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\|#(?=##)|<(?=/turn>)", r"\\$0")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    for plain, coded in ROLE_ESCAPES:
        role = F.replace(role, F.lit(plain), F.lit(coded))
    return role


def unescape_role(role: Column) -> Column:
    for plain, coded in reversed(ROLE_ESCAPES):
        role = F.replace(role, F.lit(coded), F.lit(plain))
    return role


def format_windows(conversations: DataFrame, *, budget: int = 512, history: int = 2, chars_per_token: int = 4) -> DataFrame:
    """conv_id, window, context, n_tokens, formatted, loss_spans: one row for each window.

    context is the number of turns at the window's start that repeat earlier
    ones; loss_spans are array<struct<start, length>> in code points of formatted.
    Tokens of a turn: its formatted length / chars_per_token, rounded up.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head, body = F.concat(F.lit("### "), escape_role(role), F.lit(":\n")), escape(text)
    turns = conversations.select(
        "conv_id", "turn", F.concat(head, body, F.lit(END)).alias("seg"), F.length(head).alias("head"), F.length(body).alias("body"),
        (role == "assistant").alias("target"), (role == "system").alias("system"), role.alias("role"), text.alias("text"),
    )
    turns = turns.withColumn("chars", F.length("seg").cast("long")).withColumn("tokens", F.ceil(F.col("chars") / chars_per_token))
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    turns = turns.select("*", F.row_number().over(order).alias("n"), F.sum("tokens").over(upto).alias("tokens_to"), F.sum("chars").over(upto).alias("chars_to"))
    kept = F.struct("n", "seg", "head", "body", "target", "chars", "tokens", "tokens_to", "chars_to")
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(kept)).alias("turns"), F.max((F.col("n") == 1) & F.col("system")).alias("system"))
    whole = whole.withColumn("fixed", F.when(F.col("system"), F.col("turns")[0]["tokens"]).otherwise(0).cast("long"))

    def back(k: int, t: Column) -> Column:
        """Tokens of the k turns before t, or null where they aren't there to be repeated."""
        first = F.when(F.col("system"), 1).otherwise(0)
        n = t["n"]
        before = F.when(n - 1 - k > 0, F.get("turns", n - 2 - k)["tokens_to"]).otherwise(0)
        return F.when(n - 1 - k >= first, t["tokens_to"] - t["tokens"] - before)

    def step(state: Column, t: Column) -> Column:
        room = F.lit(budget).cast("long") - F.col("fixed")
        fits = (F.size(state["starts"]) > 0) & (state["used"] + t["tokens"] <= state["room"])
        repeat = F.lit(0)
        for k in range(1, history + 1):
            repeat = F.when(F.coalesce(back(k, t) + t["tokens"] <= room, F.lit(False)), k).otherwise(repeat)
        again = F.lit(0).cast("long")
        for k in range(1, history + 1):
            again = F.when(repeat == k, back(k, t)).otherwise(again)
        repeat, again = (F.when(F.size(state["starts"]) > 0, x).otherwise(0) for x in (repeat, again))
        start = F.struct(t["n"].cast("int").alias("at"), repeat.cast("int").alias("repeat"))
        return F.struct(
            F.when(fits, state["starts"]).otherwise(F.array_append(state["starts"], start)).alias("starts"),
            (F.when(fits, state["used"]).otherwise(again) + t["tokens"]).cast("long").alias("used"),
            F.when(F.size(state["starts"]) > 0, F.when(fits, state["room"]).otherwise(room)).otherwise(F.lit(budget).cast("long")).cast("long").alias("room"),
        )

    zero = F.expr(f"named_struct('starts', cast(array() as array<struct<at:int,repeat:int>>), 'used', 0L, 'room', {budget}L)")
    whole = whole.withColumn("starts", F.aggregate("turns", zero, step, lambda s: s["starts"]))

    def window(w: Column, i: Column) -> Column:
        after = F.coalesce(F.get("starts", i + 1)["at"], F.size("turns") + 1)
        span = F.slice("turns", w["at"] - w["repeat"], after - w["at"] + w["repeat"])
        system = F.when((i > 0) & F.col("system"), F.col("turns")[0])
        return F.struct(i.alias("window"), system.alias("first"), w["repeat"].alias("repeat"), span.alias("span"))

    rows = whole.select("conv_id", F.explode(F.transform("starts", window)).alias("w")).select("conv_id", "w.*")
    before = F.coalesce(F.col("first.chars"), F.lit(0)) - (F.col("span")[0]["chars_to"] - F.col("span")[0]["chars"])
    return rows.select(
        "conv_id",
        F.col("window").cast("int").alias("window"),
        (F.col("repeat") + F.when(F.col("first").isNotNull(), 1).otherwise(0)).alias("context"),
        (F.coalesce(F.col("first.tokens"), F.lit(0)) + F.aggregate("span", F.lit(0).cast("long"), lambda a, t: a + t["tokens"])).alias("n_tokens"),
        F.concat(F.coalesce("first.seg", F.lit("")), F.array_join(F.transform("span", lambda t: t["seg"]), "")).alias("formatted"),
        F.transform(
            F.filter(F.slice("span", F.col("repeat") + 1, F.size("span")), lambda t: t["target"]),
            lambda t: F.struct((t["chars_to"] - t["chars"] + before + t["head"]).alias("start"), t["body"].cast("long").alias("length")),
        ).alias("loss_spans"),
    )


def read_turns(windows: DataFrame) -> DataFrame:
    """windows with turns array<struct<role, text>> (repeated ones left out) and loss array<string>, both read back from formatted."""
    segs = F.filter(F.split("formatted", END, -1), lambda s, i: i >= F.col("context"))
    segs = F.slice(segs, 1, F.greatest(F.size(segs) - 1, F.lit(0)))

    def turn(s: Column) -> Column:
        end = F.instr(s, ":\n")
        return F.struct(unescape_role(F.substring(s, F.lit(5), end - 5)).alias("role"), unescape(F.substring(s, end + 2, F.length(s))).alias("text"))

    loss = F.transform("loss_spans", lambda x: unescape(F.substring(F.col("formatted"), (x["start"] + 1).cast("int"), x["length"].cast("int"))))
    return windows.select("*", F.transform(segs, turn).alias("turns"), loss.alias("loss"))


def digest(windows: DataFrame) -> DataFrame:
    """One row for each conversation: counts and hashes of what its windows hold."""
    read = read_turns(windows).select(
        "conv_id", "window", F.size("turns").cast("long").alias("n"), F.length("formatted").cast("long").alias("chars"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
        F.array_join("loss", "").alias("loss"),
    )
    whole = read.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.sum(F.length("loss").cast("long")).alias("loss_chars"),
        F.array_sort(F.collect_list(F.struct("window", "said", "loss"))).alias("w"),
    )
    said, loss = (F.sha2(F.array_join(F.col(f"w.{x}"), "").cast("binary"), 256) for x in ("said", "loss"))
    return whole.select("conv_id", "n_turns", said.alias("turns_sha256"), "loss_chars", loss.alias("loss_sha256"), "formatted_chars")
