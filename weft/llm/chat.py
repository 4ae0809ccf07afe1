"""Chat formatting in budgeted windows, by DataFrame functions only.

A turn is written ``<|role|>text<|end|>``; inside texts a backslash becomes
``\\s`` and ``<|`` becomes ``\\l|``, inside roles a bar becomes ``\\p``, so the
output reads back to the exact turns. Prefix sums of turn tokens cut each run
of ``RUN`` turn numbers of a conversation into turn-aligned spans: with ``cap``
tokens left for new turns, turns that lie within one multiple of ``cap`` make a
span and a turn that crosses a multiple is a span of its own. Each span's
window repeats the conversation's first system turn and up to ``history``
earlier turns of its run within ``history_tokens``; the loss mask covers the
text of new assistant turns alone, so each is learned once.

No window has more tokens than ``budget`` unless it is a single new turn that
alone has more, with nothing repeated: what does not fit beside the new turns
is left out, history first, then the system turn; a system turn of more than
half the budget is never repeated.

A conversation of one run is made and digested behind one shuffle of its
texts; the runs of longer ones are spread over tasks, and their system turn
travels to each run.

Results for odd input: a null text or role is empty; null turn numbers come
first and ties are ordered by role and text; a null ``conv_id`` is one more
conversation, and ids of any type are kept; repeated rows are turns of their
own; an empty table gives no windows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.arrow import plain
from weft.plans.lineage import stored

BUDGET, HISTORY, HISTORY_TOKENS, RUN = 512, 2, 96, 256
#: Tokens: runs of letters or digits, and other marks; ``MARKS`` for a turn's control strings.
TOKEN, MARKS = r"[\p{L}\p{M}]+|\p{N}+|[^\s\p{L}\p{M}\p{N}]", 3
END = "<|end|>"
#: Most runs of long conversations (a key and two numbers each) in one broadcast.
BROADCAST_RUNS = 200_000


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<|"), F.lit("\\l|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l|"), F.lit("<|")), F.lit("\\s"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("|"), F.lit("\\p"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("\\p"), F.lit("|")), F.lit("\\s"), F.lit("\\"))


def _turns(rows: DataFrame) -> DataFrame:
    """Every turn with its run of turn numbers, its tokens and its texts."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    return plain(rows, "conv_id", "turn", "role", "text").select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("null")).alias("key"),
        "conv_id",
        "turn",
        F.floor(F.col("turn") / RUN).alias("run"),
        F.lit(1).alias("own"),
        role.alias("role"),
        text.alias("text"),
        (F.regexp_count(text, F.lit(TOKEN)) + MARKS).cast("bigint").alias("tokens"),
    )


def _long(turns: DataFrame) -> DataFrame:
    """``key, run, before`` of conversations with several runs: the turns that
    come before each run."""
    runs = turns.groupBy("key", "run").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("key")
    upto = whole.orderBy(F.col("run").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    placed = runs.select("key", "run", F.count("*").over(whole).alias("runs"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    return stored(placed.where("runs > 1").select("key", "run", "before"), "chat-long")


def _repeats(turns: DataFrame, long: DataFrame) -> DataFrame:
    """The first system turn of a long conversation, once for each later run."""
    first = turns.where("role = 'system'").groupBy("key").agg(F.min(F.struct("turn", "text", "run", "tokens")).alias("s"))
    later = F.col("s.run").isNull() & F.col("run").isNotNull() | F.coalesce(F.col("run") > F.col("s.run"), F.lit(False))
    met = first.join(long.select("key", "run"), "key").where(later)
    blank = [F.lit(None).cast(turns.schema[n].dataType).alias(n) for n in ("conv_id", "turn")]
    return met.select("key", *blank, "run", F.lit(0).alias("own"), F.lit("system").alias("role"), F.col("s.text").alias("text"), F.col("s.tokens").alias("tokens"))


def _formatted(turns: DataFrame, budget: int, history: int, history_tokens: int) -> DataFrame:
    """Windows with ``run`` and, in ``first_turn``, the place within it.

    One shuffle by conversation and run; all that follows keeps its order.
    """
    if history_tokens >= budget // 2 or min(history, history_tokens) < 0:
        raise ValueError("the history must take less than half of the budget")
    inside = Window.partitionBy("key", "run").orderBy("own", F.col("turn").asc_nulls_first(), "role", "text")
    upto = inside.rowsBetween(Window.unboundedPreceding, -1)
    own = F.col("own")
    head, body = F.concat(F.lit("<|"), escape_role(F.col("role")), F.lit("|>")), escape(F.col("text"))
    written = turns.select("key", "conv_id", "turn", "run", "own", "role", "text", "tokens", F.length(head).alias("head"), F.length(body).cast("bigint").alias("body"), F.concat(head, body, F.lit(END)).alias("w"))
    placed = written.withColumns({
        "place": F.sum(own).over(inside.rowsBetween(Window.unboundedPreceding, 0)),
        "prefix": F.coalesce(F.sum(own * F.col("tokens")).over(upto), F.lit(0)),
        "at": F.coalesce(F.sum(own * F.length("w")).over(upto), F.lit(0)),
    })
    piece = F.struct("place", "own", "tokens", "w")
    placed = placed.withColumns({f"h{j}": F.lag(piece, j).over(inside) for j in range(1, history + 1)})
    placed = placed.withColumn("system", F.min(F.when(F.col("role") == "system", F.struct("place", "tokens", "w"))).over(Window.partitionBy("key", "run")))
    st = F.col("system.tokens")
    short = F.coalesce(st <= budget // 2, F.lit(False))
    cap = F.lit(budget - history_tokens) - F.when(short, st).otherwise(0)
    low, high = F.floor(F.col("prefix") / cap), F.floor((F.col("prefix") + F.col("tokens") - 1) / cap)
    spanned = placed.where("own = 1").withColumn("span", 2 * low + (low != high).cast("int"))
    earlier = [f"h{j}" for j in range(1, history + 1)]
    made = spanned.groupBy("key", "run", "span").agg(
        F.max("conv_id").alias("conv_id"),
        F.min("place").alias("first_turn"),
        F.count("*").alias("n_turns"),
        F.sum("tokens").alias("new"),
        F.min("at").alias("base"),
        F.min_by(F.struct("system", *earlier), "place").alias("o"),
        F.array_sort(F.collect_list(F.struct("place", "w", "at", "head", "body", (F.col("role") == "assistant").alias("target")))).alias("pieces"),
    )
    # What does not fit beside the new turns is left out: history first, then the system turn.
    s = F.col("o.system")
    keeps = F.coalesce((s["place"] < F.col("first_turn")) & (s["tokens"] <= budget // 2) & (s["tokens"] + F.col("new") <= budget), F.lit(False))
    room = F.least(F.lit(history_tokens), F.lit(budget) - F.col("new") - F.when(keeps, s["tokens"]).otherwise(0))
    lead, used, spent = [F.when(keeps, s["w"])], F.when(keeps, s["tokens"]).otherwise(0), F.lit(0)
    back = []
    for name in earlier:
        h = F.col(f"o.{name}")
        there = F.coalesce((h["own"] == 1) & ~F.coalesce(h["place"] == s["place"], F.lit(False)), F.lit(False))
        spent = spent + F.when(there, h["tokens"]).otherwise(0)
        stays = there & (spent <= room)
        back.append(F.when(stays, h["w"]))
        used = used + F.when(stays, h["tokens"]).otherwise(0)
    lead = F.filter(F.array(*lead, *reversed(back)), lambda x: x.isNotNull())
    made = made.select("key", "run", "conv_id", "first_turn", "n_turns", "base", "pieces", F.size(lead).cast("bigint").alias("n_repeated"), (F.col("new") + used).cast("bigint").alias("tokens"), F.array_join(lead, "").alias("lead"))
    start = lambda p: F.length("lead") + p["at"] - F.col("base") + p["head"]
    loss = F.transform(F.filter("pieces", lambda p: p["target"]), lambda p: F.struct(start(p).cast("bigint").alias("start"), (start(p) + p["body"]).cast("bigint").alias("end")))
    text = F.concat("lead", F.array_join(F.col("pieces.w"), ""))
    return made.select("conv_id", "key", "run", "first_turn", "n_turns", "n_repeated", "tokens", text.alias("text"), loss.alias("loss"))


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Turns of conversations of one run, those of longer ones with their
    repeated system turns, and the runs of the longer ones."""
    turns = _turns(rows)
    long = _long(turns)
    runs = long.count()
    if not runs:
        return turns, None, None
    keys = long.select("key").distinct()
    if runs <= BROADCAST_RUNS:
        keys, long = F.broadcast(keys), F.broadcast(long)
    many = turns.join(keys, "key", "left_semi")
    return turns.join(keys, "key", "left_anti"), many.unionByName(_repeats(many, long)), long


def _joined_windows(rows: DataFrame, budget: int, history: int, history_tokens: int) -> tuple[DataFrame, DataFrame | None]:
    """Windows of the short conversations and of the long ones, ordinals whole."""
    one, many, long = _split(rows)
    short = _formatted(one, budget, history, history_tokens)
    if many is None:
        return short, None
    at = long.select(F.col("key").alias("key2"), F.col("run").alias("run2"), "before")
    parts = _formatted(many, budget, history, history_tokens).join(at, (F.col("key") == F.col("key2")) & F.col("run").eqNullSafe(F.col("run2")))
    return short, parts.withColumn("first_turn", F.col("before") + F.col("first_turn")).select(*short.columns)


def windows(rows: DataFrame, budget: int = BUDGET, history: int = HISTORY, history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """``conv_id, key, run, first_turn, n_turns, n_repeated, tokens, text, loss``.

    ``first_turn`` is the ordinal of the window's first new turn, ``n_turns``
    counts its new turns and ``n_repeated`` the repeated ones before them;
    ``loss`` holds half-open character spans of ``text``.
    """
    short, many = _joined_windows(rows, budget, history, history_tokens)
    return short if many is None else short.unionByName(many)


def read_back(made: DataFrame) -> DataFrame:
    """Each window's new turns and learned text, parsed from its output."""
    written = F.split("text", r"<\|end\|>", -1)
    fresh = F.slice(written, F.col("n_repeated").cast("int") + 1, F.greatest(F.size(written) - 1 - F.col("n_repeated").cast("int"), F.lit(0)))

    def turn(w: Column) -> Column:
        cut = F.instr(w, "|>")
        return F.concat(unescape_role(F.substring(w, F.lit(3), cut - 3)), F.lit("\n"), unescape(F.substring(w, cut + 2, F.length(w))), F.lit("\n"))

    learned = F.transform("loss", lambda s: unescape(F.substring(F.col("text"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return made.select("key", "run", "conv_id", "first_turn", "n_turns", F.array_join(F.transform(fresh, turn), "").alias("turns"), F.array_join(learned, "").alias("learned"), F.length("text").cast("bigint").alias("chars"))


def _gathered(parts: DataFrame, by: list[str], order: str) -> DataFrame:
    """Texts and counts of ``parts``, joined in order."""
    one = parts.groupBy(*by).agg(
        F.max("conv_id").alias("conv_id"),
        F.sum("n_turns").cast("bigint").alias("n_turns"),
        F.min("first_turn").alias("first_turn"),
        F.array_sort(F.collect_list(F.struct(order, "turns", "learned"))).alias("p"),
        F.sum("chars").alias("chars"),
    )
    joined = [F.array_join(F.col(f"p.{name}"), "").alias(name) for name in ("turns", "learned")]
    return one.select(*by, "conv_id", "n_turns", "first_turn", *joined, "chars")


def digests(rows: DataFrame, budget: int = BUDGET, history: int = HISTORY, history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """Counts and digests of every conversation, read back from its windows.

    A digest needs its conversation's text in one value; the windows do not.
    A conversation of one run is whole where its windows are made, so that
    only long ones are brought together by another shuffle.
    """
    short, many = _joined_windows(rows, budget, history, history_tokens)
    by = ["key", "run"]
    one = _gathered(read_back(short), by, "first_turn").drop(*by)
    if many is not None:
        one = one.unionByName(_gathered(_gathered(read_back(many), by, "first_turn"), ["key"], "first_turn").drop("key"))
    digest = lambda name: F.sha2(F.col(name).cast("binary"), 256)
    return one.select("conv_id", "n_turns", digest("turns").alias("turns_sha256"), F.length("learned").cast("bigint").alias("loss_chars"), digest("learned").alias("loss_sha256"), F.col("chars").alias("formatted_chars"))


#: The digests in DuckDB, straight from the turns; only the written length follows the windows.
SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), f AS (
  SELECT *, floor(turn / {float(RUN)}) AS run,
         length('<|' || replace(replace(role, '\', '\s'), '|', '\p') || '|>') + length(replace(replace(text, '\', '\s'), '<|', '\l|')) + {len(END)} AS written,
         len(regexp_extract_all(text, '{TOKEN}')) + {MARKS} AS tokens,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n
  FROM t
), p AS (
  SELECT *, CAST(coalesce(sum(tokens) OVER (PARTITION BY conv_id, run ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prefix FROM f
), first AS (
  SELECT conv_id, n AS sn, run AS srun, tokens AS st, written AS sw FROM f
  WHERE role = 'system' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n) = 1
), own AS (
  SELECT conv_id, run, min(n) AS n0 FROM f GROUP BY conv_id, run
), own_system AS (
  -- A run before the first system turn has none; its own run and the later ones have it.
  SELECT o.conv_id, o.run, s.sn, s.st, s.sw FROM own o JOIN first s ON s.conv_id = o.conv_id AND (o.n0 > s.sn OR o.run IS NOT DISTINCT FROM s.srun)
), c AS (
  SELECT p.*, s.sn, s.sw, s.st, {BUDGET - HISTORY_TOKENS} - CASE WHEN s.st <= {BUDGET // 2} THEN s.st ELSE 0 END AS cap
  FROM p LEFT JOIN own_system s ON s.conv_id = p.conv_id AND s.run IS NOT DISTINCT FROM p.run
), spans AS (
  SELECT *, 2 * (prefix // cap) + CASE WHEN prefix // cap <> (prefix + tokens - 1) // cap THEN 1 ELSE 0 END AS span FROM c
), starts AS (
  SELECT conv_id, run, span, min(n) AS a, max(sn) AS sn, max(st) AS st, max(sw) AS sw, sum(tokens) AS new FROM spans GROUP BY conv_id, run, span
), kept AS (
  SELECT *, coalesce(sn < a AND st <= {BUDGET // 2} AND st + new <= {BUDGET}, false) AS keeps FROM starts
), back AS (
  SELECT x.conv_id, f.written, x.room, sum(f.tokens) OVER (PARTITION BY x.conv_id, x.run, x.span ORDER BY x.j) AS so_far
  FROM (SELECT conv_id, run, span, a, sn, least({HISTORY_TOKENS}, {BUDGET} - new - CASE WHEN keeps THEN st ELSE 0 END) AS room, unnest(range(1, {HISTORY + 1})) AS j FROM kept) x
  JOIN f ON f.conv_id = x.conv_id AND f.n = x.a - x.j AND f.run IS NOT DISTINCT FROM x.run AND f.n IS DISTINCT FROM x.sn
), again AS (
  SELECT conv_id, sum(w) AS w FROM (
    SELECT conv_id, sw AS w FROM kept WHERE keeps
    UNION ALL SELECT conv_id, written FROM back WHERE so_far <= room) GROUP BY conv_id
)
SELECT f.conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(written) + coalesce(max(again.w), 0) AS BIGINT) AS formatted_chars
FROM f LEFT JOIN again ON again.conv_id = f.conv_id GROUP BY f.conv_id
"""
