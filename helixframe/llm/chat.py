r"""Chat formatting: turns rendered by a template, parsed back, and escaped where they don't come back as they were.

Grammar of a rendered conversation; every other character stands for itself:

    conversation := turn*
    turn         := "### " role ": " text "</turn>\n"
    role, text   := any characters, but neither "### " nor "</turn>", and in a role no ": "; "\x" stands for x

A turn is first rendered as it is. Where the parser doesn't give the same role and text back, the template's marks in it
are broken by a backslash ("##\# ", "<\/turn>", ":\ "); where that doesn't come back either, since the content has
backslashes of its own, these are doubled as well, which always comes back. No turn holds a mark of the template then,
so a conversation parses as its turns do, and each is rendered by itself, wherever its conversation's other turns are.

All of it is column expressions: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The template's control strings.
START, AFTER_ROLE, END, NEWLINE, ESCAPE = "### ", ": ", "</turn>", "\n", "\\"
#: Each control string, and how it stands in escaped content; the last is one in roles only.
BROKEN = ((START, "##\\# "), (END, "<\\/turn>"), (AFTER_ROLE, ":\\ "))
#: Ways to escape, in the order in which they are tried.
LEVELS = 3


def escaped(content: Column, level: int, role: bool = False) -> Column:
    """Content as rendered at a level: 0 as it is, 1 with broken marks, 2 with doubled backslashes as well."""
    if level == 2:
        content = F.replace(content, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    for mark, broken in BROKEN[: (3 if role else 2) * (level > 0)]:
        content = F.replace(content, F.lit(mark), F.lit(broken))
    return content


def unescaped(content: Column) -> Column:
    """What escaped content stands for: a backslash and a character are that character."""
    return F.regexp_replace(content, r"(?s)\\(.)", "$1")


def render(role: Column, text: Column, level: int) -> Column:
    """One turn by the template."""
    return F.concat(F.lit(START), escaped(role, level, True), F.lit(AFTER_ROLE), escaped(text, level), F.lit(END + NEWLINE))


def parse(rendered: Column) -> Column:
    """The turns of a rendered conversation, array<struct<role, text>>; null if it isn't one by the grammar."""
    found = F.split(rendered, START, -1)

    def turn(piece: Column) -> Column:
        role, body = F.substring_index(piece, AFTER_ROLE, 1), F.substring_index(piece, END, 1)
        after = F.char_length(role) + len(AFTER_ROLE)
        whole = (piece == F.concat(body, F.lit(END + NEWLINE))) & (F.char_length(body) >= after)
        return F.when(whole, F.struct(unescaped(role).alias("role"), unescaped(F.substring(body, after + 1, F.char_length(body))).alias("text")))

    turns = F.transform(F.slice(found, F.lit(2), F.greatest(F.size(found) - 1, F.lit(0))), turn)
    return F.when((F.element_at(found, 1) == "") & F.forall(turns, lambda t: t.isNotNull()), turns)


def format_turns(df: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Rows (conv_id, turn, role, text) to one row a turn: conv_id, position, role, formatted, level, start, loss_start, loss_end.

    `formatted` is the turn's piece of its conversation's rendered text, which is the pieces by position, joined by
    nothing; `start` is where it begins there, and the loss mask covers [loss_start, loss_end) of it, in code points: the
    text of a turn of a role in `trained`, without its template (other turns: an empty span). `level` says how it was
    escaped. Turns stand by turn, null first; ties by role and text; repeated rows stay. Null roles and texts are empty,
    rows of a null conv_id one conversation; other columns are left out; an empty table gives no rows. A turn that came
    back changed at the last level would end the job.
    A conversation passes one task's sort, which spills; only its running length is carried along, so it needn't fit there.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = df.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    kept = F.array(F.struct(F.col("role").alias("role"), F.col("text").alias("text")))
    pick = None
    for level in range(LEVELS):
        tried = render(F.col("role"), F.col("text"), level)
        head = F.char_length(escaped(F.col("role"), level, True)) + len(START + AFTER_ROLE)
        found = F.struct(tried.alias("formatted"), F.lit(level).alias("level"), head.cast("long").alias("head"))
        pick = F.when(parse(tried) == kept, found) if pick is None else pick.when(parse(tried) == kept, found)
    pieces = turns.withColumn("made", pick.otherwise(F.raise_error(F.lit("a turn doesn't come back from its rendered text"))))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    size = F.char_length("made.formatted").cast("long")
    begin, end = F.col("start") + F.col("made.head"), F.col("start") + F.col("size") - len(END + NEWLINE)
    placed = pieces.withColumn("size", size).select(
        "conv_id", F.row_number().over(order).cast("long").alias("position"), "role", "made", "size", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    learned = F.col("role").isin(*trained)
    return placed.select("conv_id", "position", "role", "made.formatted", "made.level", "start", begin.alias("loss_start"), F.when(learned, end).otherwise(begin).alias("loss_end"))


def conversations(formatted: DataFrame) -> DataFrame:
    """format_turns' rows to one row a conversation: conv_id, formatted, loss_spans (array of start and end), masked (what they cover, unescaped).

    A rendered conversation is one string here, so it must fit a task, and Spark's 2 GB for a string; longer ones stay in
    the rows of format_turns.
    """
    inside = F.substring(F.col("formatted"), (F.col("loss_start") - F.col("start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int"))
    span = F.struct(F.col("loss_start").alias("start"), F.col("loss_end").alias("end"))
    row = F.struct("position", "formatted", span.alias("span"), unescaped(inside).alias("masked"))
    joined = lambda field: F.array_join(F.transform("rows", lambda r: r[field]), "")
    return formatted.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("rows")).select(
        "conv_id", joined("formatted").alias("formatted"), F.filter(F.transform("rows", lambda r: r["span"]), lambda s: s["end"] > s["start"]).alias("loss_spans"), joined("masked").alias("masked"))


def read_back(texts: DataFrame) -> DataFrame:
    """conversations' rows, read by the parser and the mask, to the digests of what they hold; a text against the grammar ends the job."""
    turns = F.coalesce(parse(F.col("formatted")), F.raise_error(F.lit("a rendered conversation is against the grammar")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return texts.withColumn("turns", turns).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.char_length("masked").cast("long").alias("loss_chars"), F.sha2("masked", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


def _sql() -> str:
    text = lambda x: "'" + x.replace("'", "''") + "'"

    def sql_escaped(x, level, role=False):
        x = f"replace({x}, {text(ESCAPE)}, {text(ESCAPE * 2)})" if level == 2 else x
        for mark, broken in BROKEN[: (3 if role else 2) * (level > 0)]:
            x = f"replace({x}, {text(mark)}, {text(broken)})"
        return x

    size = lambda n: f"length({sql_escaped('role', n, True)}) + length({sql_escaped('body', n)}) + {len(START + AFTER_ROLE + END + NEWLINE)}"
    plain = " AND ".join([f"NOT contains({x}, {text(m)})" for x in ("role", "body") for m in (START, END)] + [f"NOT contains(role, {text(AFTER_ROLE)})"])
    same = lambda n: " AND ".join(rf"regexp_replace({sql_escaped(x, n, x == 'role')}, '(?s)\\(.)', '\1', 'g') = {x}" for x in ("role", "body"))
    return f"""
WITH given AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', {text(AWKWARD)} UNION ALL SELECT -7, 1, 'assistant', {text(AWKWARD)}
), turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS body,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM given
), sized AS (
  SELECT *, CASE WHEN {plain} AND {same(0)} THEN {size(0)} WHEN {same(1)} THEN {size(1)} ELSE {size(2)} END AS size FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || body || chr(10), '' ORDER BY n)) AS turns_sha256,
       coalesce(sum(length(body)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(body, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(size)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id"""


#: The text of both turns of conversation -7 of the query.
AWKWARD = "\\### Assistant: </turn> ok"
SQL = _sql()
