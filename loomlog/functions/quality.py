"""Quality rules as column expressions: prompt facts, outcome, score, grade and shape of a session."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words and patterns that prompt facts look for.
CHANGE_VERBS = "fix change add implement refactor update remove delete rename replace edit modify patch revert migrate rewrite extend adjust tweak".split()
FILE_EXTENSIONS = "go ts tsx js jsx mjs cjs py rs rb java kt kts c cc cpp cxx h hpp hxx cs php swift scala clj ex exs sh bash zsh sql css scss sass less html htm xml ya?ml toml ini cfg md rst txt proto graphql vue svelte".split()
BARE_FILES = r"dockerfile makefile rakefile gemfile procfile jenkinsfile vagrantfile justfile go\.mod go\.sum cargo\.lock".split()
DOT_FILES = "gitignore dockerignore env".split()
PLEASANTRIES = "hi hey hello yo sup howdy greetings good morning afternoon evening there all everyone team folks claude friend my how are you doing today please thanks hiya".split()
#: Prompts under so many words are short; gaps, floors and weights of the score.
SHORT_WORDS = 4
GRADES = [("A", 90), ("B", 75), ("C", 60), ("D", 40), ("F", 0)]
POINTS = {"A": 4, "B": 3, "C": 2, "D": 1, "F": 0}
OUTCOMES = ["completed", "abandoned", "errored", "unknown"]
ARCHETYPES = ["quick", "standard", "deep", "marathon", "automation"]

# ASCII word edges: Java's \b would count letters beyond ASCII as part of a word.
_L, _R = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
_SPACE = r"[\s\x{A0}\x{85}]+"


def _any(*patterns: str) -> str:
    return "(?i)" + "|".join(patterns)


def prompt_words(text: Column) -> Column:
    return F.filter(F.split(text, _SPACE), lambda w: w != "")


def prompt_short(text: Column) -> Column:
    return F.size(prompt_words(text)) < SHORT_WORDS


def prompt_no_code(text: Column) -> Column:
    """A change is asked for, and nothing names code: no fence, inline code, file or path of three segments."""
    verb = text.rlike(_any(f"{_L}(?:{'|'.join(CHANGE_VERBS)}){_R}"))
    anchor = _any(rf"{_L}[\w.-]+\.(?:{'|'.join(FILE_EXTENSIONS)}){_R}", rf"{_L}(?:{'|'.join(BARE_FILES)}){_R}", rf"(?:^|[^\w.])\.(?:{'|'.join(DOT_FILES)}){_R}", r"[\w.-]+/[\w.-]+/[\w./-]+")
    return verb & ~(text.rlike(anchor) | (F.size(F.split(text, "`")) > 2))


def prompt_greeting(text: Column) -> Column:
    """Only greeting words, whatever marks stand around them."""
    tokens = prompt_words(text)
    bare = F.transform(tokens, lambda w: F.lower(F.regexp_replace(w, r"^[.,!?;:]+|[.,!?;:]+$", "")))
    return (F.size(tokens) > 0) & F.forall(bare, lambda w: w.isin(PLEASANTRIES))


def prompt_digest(text: Column) -> Column:
    """Equal for prompts that differ only in case and spacing."""
    return F.sha2(F.array_join(prompt_words(F.lower(text)), " "), 256)


def outcome(pick: int = 0) -> Column:
    """The nine ordered branches, over tail_failures, pending, idle, user_message_count, last_user, last_assistant.

    pick 0 gives the outcome, 1 the confidence.
    """
    c = F.col
    branches = [
        (c("tail_failures") >= 3, ("errored", "high")),
        (c("pending") & ~c("idle"), ("unknown", "low")),
        (c("pending") & (c("user_message_count") == 0), ("errored", "medium")),
        (c("pending"), ("abandoned", "medium")),
        ((c("user_message_count") == 0) & (c("last_assistant") >= 0) & c("idle"), ("completed", "medium")),
        (c("user_message_count") == 0, ("unknown", "low")),
        ((c("last_assistant") < 0) & (c("last_user") < 0), ("unknown", "low")),
        (c("last_assistant") > c("last_user"), ("completed", "high")),
        ((c("last_user") > c("last_assistant")) & c("idle"), ("abandoned", "medium")),
    ]
    out = F
    for test, value in branches:
        out = out.when(test, value[pick])
    return out.otherwise(("unknown", "low")[pick])


def penalties() -> list[tuple[str, Column, Column]]:
    """(noun, count or null, points) of each kind of trouble, over the session's counts."""
    c = F.col
    return [
        ("errored ending", F.lit(None).cast("long"), F.when(c("outcome") == "errored", 30).otherwise(0)),
        ("abandoned", F.lit(None).cast("long"), F.when(c("outcome") == "abandoned", 15).otherwise(0)),
        ("tool failure", c("tool_failures"), F.least(3 * c("tool_failures"), F.lit(30))),
        ("retry", c("tool_retries"), F.least(5 * c("tool_retries"), F.lit(25))),
        ("churned edit", c("edit_churn"), F.least(4 * c("edit_churn"), F.lit(20))),
        ("failure streak", F.lit(None).cast("long"), F.when(c("streak") >= 3, 10).otherwise(0)),
    ]


def is_scored() -> Column:
    return (F.col("outcome") != "unknown") | F.expr("tool_failures > 0 OR tool_retries > 0 OR edit_churn > 0 OR streak > 0")


def score() -> Column:
    total = sum((p for _, _, p in penalties()), F.lit(0))
    return F.when(is_scored(), F.greatest(F.lit(0), 100 - total))


def breakdown() -> Column:
    """array of (label, points) of the penalties that count, for a scored session."""
    items = []
    for noun, n, points in penalties():
        many = noun[:-1] + "ies" if noun.endswith("y") else noun + "s"
        label = F.when(n.isNull(), F.lit(noun)).otherwise(F.concat(n.cast("string"), F.when(n == 1, f" {noun}").otherwise(f" {many}")))
        items.append(F.struct(label.alias("label"), points.cast("long").alias("points")))
    return F.when(is_scored(), F.filter(F.array(*items), lambda x: x["points"] > 0))


def grade(value: Column) -> Column:
    out = F.when(value.isNull(), "")
    for letter, least in GRADES:
        out = out.when(value >= least, letter)
    return out


def grade_points(letter: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in POINTS.items() for x in kv]), letter)


def minutes() -> Column:
    return F.coalesce(F.expr("unix_micros(ended_at) - unix_micros(started_at)"), F.lit(0)) / 6e7


def archetype() -> Column:
    m, n = minutes(), F.col("message_count")
    out = F.when(F.col("user_message_count") == 0, "automation")
    for name, least_minutes, least_messages in (("marathon", 120, 200), ("deep", 30, 60), ("standard", 5, 15)):
        out = out.when((m >= least_minutes) | (n >= least_messages), name)
    return out.otherwise("quick")


def thinking_band(tokens: Column) -> Column:
    return F.when(tokens <= 128, "low").when(tokens <= 512, "medium").when(tokens <= 2048, "high").otherwise("xhigh")


def heat_level(value: Column, top: Column) -> Column:
    r = F.sqrt(value / top)
    return F.when((value <= 0) | (top <= 0), 0).when(r <= 0.25, 1).when(r <= 0.5, 2).when(r <= 0.75, 3).otherwise(4)
