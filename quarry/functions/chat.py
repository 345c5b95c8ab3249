"""Chat records as Spark arrays of (role, content) structs (PRJ-3..7)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import repair_hint_text, strip

# -- fixed values: prompt texts and chat turn markers --------------------------
SYSTEM_PROMPT = (
    "You are a precise text-to-SQL engine. Given a SQLite schema and a question, "
    "reply with a single valid SQLite query that answers it. "
    "Output only the SQL. No explanation, no markdown, no commentary."
)
SCHEMA_HEAD = "### Schema\n"
QUESTION_HEAD = "\n\n### Question\n"
TURN_OPEN = "<|im_start|>"
TURN_CLOSE = "<|im_end|>\n"
REPAIR_HEADS = ("### Schema\n", "\n\n### Question\n", "\n\n### Your previous answer\n",
                "\n\n### It failed with this SQLite error\n", "\n\n")
REPAIR_ASK = ("Rewrite the query so it runs. Use only tables and columns that appear in the\n"
              "schema above.")
REPAIR_LAST = "\n\nOutput only the corrected SQL, and make it different from the previous answer."
# -----------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def user_content(schema, question) -> Column:
    return F.concat(F.lit(SCHEMA_HEAD), strip(schema), F.lit(QUESTION_HEAD), strip(question))


def msg(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def messages(schema, question, answer) -> Column:
    """[system, user, assistant] (PRJ-3)."""
    return F.array(msg("system", F.lit(SYSTEM_PROMPT)),
                   msg("user", user_content(schema, question)),
                   msg("assistant", _c(answer)))


def prompt_only(m) -> Column:
    """messages[:-1] (PRJ-4)."""
    m = _c(m)
    return F.slice(m, 1, F.size(m) - 1)


def user_turn(m) -> Column:
    """messages[1].content (PRJ-4)."""
    return F.element_at(_c(m), 2).getField("content")


def render(m) -> Column:
    """One training text with turn markers (PRJ-5)."""
    return F.array_join(F.transform(_c(m), lambda x: F.concat(
        F.lit(TURN_OPEN), x["role"], F.lit("\n"), x["content"], F.lit(TURN_CLOSE))), "")


def render_prompt(user) -> Column:
    """System + user turn and the assistant opener (PRJ-6)."""
    return F.concat(F.lit(TURN_OPEN + "system\n" + SYSTEM_PROMPT + TURN_CLOSE),
                    F.lit(TURN_OPEN + "user\n"), _c(user), F.lit(TURN_CLOSE),
                    F.lit(TURN_OPEN + "assistant\n"))


def replace_first(s, old, new) -> Column:
    """Replace only the first occurrence of ``old`` (PRJ-7; Spark's
    ``replace`` replaces all)."""
    s, old, new = _c(s), _c(old), _c(new)
    pos = F.position(old, s)
    spliced = F.concat(s.substr(F.lit(1), pos - 1), new,
                       s.substr(pos + F.length(old), F.length(s) + 1))
    return F.when(pos > 0, spliced).otherwise(s)


def repair_prompt(schema, question, sql, err) -> Column:
    """Repair prompt: schema, question, previous SQL, error, and the hint
    for the error class (PRJ-8)."""
    h = REPAIR_HEADS
    return F.concat(F.lit(h[0]), strip(schema), F.lit(h[1]), strip(question), F.lit(h[2]), _c(sql),
                    F.lit(h[3]), _c(err), F.lit(h[4]), F.lit(REPAIR_ASK), repair_hint_text(err), F.lit(REPAIR_LAST))
