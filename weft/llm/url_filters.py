r"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a host rule (host and path prefix; fits the host and its subdomains) or a pattern over the
lower-cased url: `*` is any text, `^` a separator or the end. Each rule is filed under the one of its literal
tokens that the fewest urls of the table have (only tokens closed on both sides, which a fitting url must
have whole; a rule without one is tried on every url). A url's tokens fetch candidate rules, and only
those run regular expressions. Of the fitting host rules the longest decides; without one, patterns do: block
if a blocking pattern fits and no allowing one does, else allow.

An index of up to INLINE_TOKENS tokens is part of the plan: rows are judged where they are read, without a
shuffle. A larger one is a broadcast table that the distinct urls' tokens are looked up in, so that no token, however
frequent, gathers urls in one task. The rules are a parameter; MAX_RULES and MAX_RULE_LENGTH bound them and so what is
broadcast (more raise an error). Only the counts of the rules' own tokens reach the driver.

Defined cases: a null url, or one without `://`, has empty host and path, and no rule fits; it is judged by the
patterns (null: allowed); of the host rules that fit the longest wins, of equally long ones the one whose text comes
last, then block over allow; repeated rows get equal verdicts; a very long url is judged whole; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import re
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

MAX_RULES = 200_000
MAX_RULE_LENGTH = 2048
INLINE_TOKENS = 200
_WORD = re.compile("[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    action: str
    text: str
    host_rule: bool = True

    @property
    def regex(self) -> str:
        if self.host_rule:
            host, _, path = self.text.partition("/")
            return rf"^(?:[^/]*\.)?{re.escape(host.lower())}{re.escape('/' + path)}"
        special = {"*": "(?s:.*)", "^": r"(?:[^a-z0-9_.%\-]|$)"}
        return "".join(special.get(c) or re.escape(c) for c in self.text.lower())

    @property
    def tokens(self) -> list[str]:
        """Literal tokens closed on both sides."""
        text = self.text.lower()
        closed = lambda k: 0 <= k < len(text) and text[k] != "*" or self.host_rule and k < 0
        return [m[0] for m in _WORD.finditer(text) if closed(m.start() - 1) and closed(m.end())]


#: The rules of the production query: host rules, then patterns.
RULES = (
    Rule("allow", "com/"), Rule("block", "example.com/en/"), Rule("allow", "www.example.com/en/"), Rule("block", "net/es/"), Rule("block", "net/fr/"),
    Rule("block", "^ads-track^", False), Rule("block", "^ads^", False), Rule("block", "^banner^", False), Rule("block", "^tracker^", False), Rule("block", "^casino^", False), Rule("block", "^utm_source=spam*", False), Rule("allow", "^press^*^ads^", False),
)


def url_host(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.translate(F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def url_path(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(url: Column) -> Column:
    return F.array_distinct(F.split(F.lower(url), "[^a-z0-9]+"))


def token_counts(pages: DataFrame, rules: tuple[Rule, ...], inline: int = INLINE_TOKENS) -> dict[str, int]:
    """How many urls have each of the rules' tokens."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    tokens = _tokens(F.col("url"))
    if len(wanted) <= inline:
        held = pages.select(F.explode(F.array_intersect(tokens, F.array(*map(F.lit, wanted)))).alias("token"))
    else:
        held = pages.select(F.explode(tokens).alias("token")).join(_lookup(pages, [(t,) for t in wanted], "token string"), "token")
    return {r["token"]: r["n"] for r in held.groupBy("token").agg(F.count("*").alias("n")).collect()}


def _lookup(pages: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """A broadcast table of the rules, which MAX_RULES and MAX_RULE_LENGTH bound."""
    return F.broadcast(pages.sparkSession.createDataFrame(rows, schema))


def index(rules: tuple[Rule, ...], counts: dict[str, int]) -> tuple[dict[str, list[Rule]], list[Rule]]:
    """Rules under their rarest token, and those tried on every url."""
    by_token: dict[str, list[Rule]] = {}
    always = []
    for rule in rules:
        if rule.tokens:
            by_token.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(rule)
        else:
            always.append(rule)
    return by_token, always


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, inline: int = INLINE_TOKENS) -> DataFrame:
    """page_id, host, path, rule and verdict of every page. More than `inline` tokens are fetched by a join."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    if any(len(r.text) > MAX_RULE_LENGTH for r in rules):
        raise ValueError(f"a rule longer than {MAX_RULE_LENGTH}")
    by_token, always = index(rules, token_counts(pages, rules, inline))
    as_row = lambda r: F.struct(F.lit(len(r.text) if r.host_rule else 0).alias("length"), F.lit(r.text).alias("rule"), F.lit(r.action).alias("action"), F.lit(r.host_rule).alias("of_host"), F.lit(r.regex).alias("regex"))
    kind = "struct<length:int,rule:string,action:string,of_host:boolean,regex:string>"
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    candidates = F.array(*map(as_row, always)).cast(f"array<{kind}>") if always else F.array().cast(f"array<{kind}>")
    tokens = _tokens(F.coalesce("url", F.lit("")))
    if by_token and len(by_token) <= inline:
        filed = F.create_map(*(x for t, rs in by_token.items() for x in (F.lit(t), F.array(*map(as_row, rs)).cast(f"array<{kind}>"))))
        fetched = F.transform(F.array_intersect(tokens, F.array(*map(F.lit, by_token))), lambda t: F.element_at(filed, t))
        candidates = F.concat(candidates, F.flatten(fetched))
    elif by_token:
        filed_rows = [(t, (len(r.text) if r.host_rule else 0, r.text, r.action, r.host_rule, r.regex)) for t, rs in by_token.items() for r in rs]
        filed = _lookup(pages, filed_rows, f"token string, candidate {kind}")
        asked = rows.select("url").where("url is not null").distinct().select("url", F.explode(tokens).alias("token"))
        fetched = asked.join(filed, "token").groupBy("url").agg(F.collect_list("candidate").alias("fetched"))
        rows = rows.join(fetched, "url", "left")
        candidates = F.concat(candidates, F.coalesce("fetched", F.array().cast(f"array<{kind}>")))
    target = F.concat("host", "path")
    fits = rows.withColumn("fitting", F.filter(candidates, lambda c: F.when(c["of_host"], F.rlike(target, c["regex"])).otherwise(F.rlike(F.lower(F.coalesce("url", F.lit(""))), c["regex"]))))
    best = F.array_max(F.filter("fitting", lambda c: c["of_host"]))
    blocked = F.exists("fitting", lambda c: ~c["of_host"] & (c["action"] == "block")) & ~F.exists("fitting", lambda c: ~c["of_host"] & (c["action"] == "allow"))
    return fits.withColumn("best", best).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.when(blocked, "block").otherwise("allow")).alias("verdict"))
