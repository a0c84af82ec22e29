"""URL rules indexed by their rarest literal token.

A rule is a regular expression.  Its literals, the tokens (whole runs of letters
and digits) that any matching URL must hold, are read off the parsed pattern.
The index has one row per rule: its literal that is rarest among all URLs.  A
URL's tokens fetch the rules that they index, and only those regular expressions
run.
"""

from __future__ import annotations

import re
from re import _parser as parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import table

UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"


class Rule(NamedTuple):
    name: str
    verdict: str
    #: ``site`` rules match host and path; ``url`` rules match the lower-cased URL
    scope: str
    regex: str

    @property
    def literals(self) -> list[str]:
        return literals_of(self.regex, UPPER + LOWER + DIGITS if self.scope == "site" else LOWER + DIGITS)


def _class_parts(items, inside: str) -> bool:
    """Whether a character class matches none of the characters of tokens."""
    negate, matched = False, set()
    for kind, value in items:
        if kind == parser.NEGATE:
            negate = True
        elif kind == parser.LITERAL:
            matched.add(value)
        elif kind == parser.RANGE:
            matched.update(range(value[0], value[1] + 1))
        else:
            return False
    return all((ord(c) in matched) == negate for c in inside)


def _ends(nodes, inside: str) -> tuple[bool, bool]:
    """Whether what a pattern matches begins, and whether it ends, with something that parts tokens (nothing does not)."""
    kinds = _kinds(nodes, inside)
    parts = lambda k: k == "part" or (k[0] == "lit" and k[1] not in inside)
    return bool(kinds) and parts(kinds[0]), bool(kinds) and parts(kinds[-1])


def _kinds(nodes, inside: str) -> list:
    """Of each node: ("lit", character), "part" (it can't be inside a token), ("maybe", begins, ends with a part), or "any"."""
    out: list = []
    for kind, value in nodes:
        if kind == parser.LITERAL:
            out.append(("lit", chr(value)))
        elif kind == parser.AT and value in (parser.AT_BEGINNING, parser.AT_BEGINNING_STRING, parser.AT_END, parser.AT_END_STRING):
            out.append("part")
        elif kind == parser.IN:
            out.append("part" if _class_parts(value, inside) else "any")
        elif kind == parser.SUBPATTERN and not value[1] and not value[2]:
            out += _kinds(value[3], inside)
        elif kind == parser.BRANCH:
            each = [_kinds(option, inside) for option in value[1]]
            out.append("part" if all(len(k) == 1 and k[0] == "part" for k in each) else "any")
        elif kind in (parser.MAX_REPEAT, parser.MIN_REPEAT) and value[0] == 0:
            out.append(("maybe", *_ends(value[2], inside)))
        elif kind in (parser.MAX_REPEAT, parser.MIN_REPEAT):
            out.append("part" if _kinds(value[2], inside) == ["part"] else "any")
        else:
            out.append("any")
    return out


def literals_of(regex: str, inside: str) -> list[str]:
    """The tokens, in lower case, that every text holds in which the pattern is found; ``inside`` are the characters of tokens there.

    A run of literal characters is a whole token only where what stands before and
    after it parts tokens, whichever way the pattern matches.
    """
    kinds = _kinds(parser.parse(regex), inside)

    def parted(i: int, step: int) -> bool:
        while 0 <= i < len(kinds):
            k = kinds[i]
            if k == "part" or (k[0] == "lit" and k[1] not in inside):
                return True
            if k[0] != "maybe" or not k[2 if step < 0 else 1]:
                return False
            i += step  # an optional piece that parts, if it is there
        return False

    found, i = [], 0
    while i < len(kinds):
        j = i
        while j < len(kinds) and kinds[j][0] == "lit" and kinds[j][1] in inside:
            j += 1
        if j > i and parted(i - 1, -1) and parted(j, 1):
            found.append("".join(k[1] for k in kinds[i:j]).lower())
        i = max(j, i + 1)
    return list(dict.fromkeys(found))


def site_rule(verdict: str, text: str) -> Rule:
    """A host (with its subdomains) and the start of a path, as in ``example.org/es/``."""
    return Rule(text, verdict, "site", "^(?:[^/]*\\.)?" + _quoted(text))


def word_rule(verdict: str, *words: str) -> Rule:
    """Words that follow each other in a URL, with one character that is no letter or digit between them."""
    regex = "(?:^|[^a-z0-9])" + "[^a-z0-9]".join(map(_quoted, words)) + "(?:[^a-z0-9]|$)"
    return Rule("-".join(words), verdict, "url", regex)


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/])", r"\\\1", text)


SITES = [
    site_rule("allow", "org/"),
    site_rule("block", "example.org/es/"),
    site_rule("block", "example.org/en/1"),
    site_rule("allow", "com/fr/"),
    site_rule("block", "com/de/"),
]
#: The method's own rules: a URL that one of them matches is blocked, any other allowed.
WORDS = [
    word_rule("block", *words.split())
    for words in (
        "casino", "casino win", "poker", "bets", "free bets", "betting", "jackpot", "pills", "cheap pills", "viagra",
        "porn", "xxx", "adult", "escort", "torrent", "warez", "payday loans",
    )
]


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def tokens_of(url: Column) -> Column:
    """Distinct tokens; the empty one, which fetches rules without literals, always is among them."""
    return F.array_distinct(F.concat(F.split(F.translate(url, UPPER, LOWER), "[^a-z0-9]+"), F.array(F.lit(""))))


def judge_urls(pages: DataFrame, rules: list[Rule], url: str = "url") -> DataFrame:
    """One row per distinct URL: (url, host, path, rule, site_verdict, matched).

    ``rule`` is the longest site rule that fits (ties: the smaller text),
    ``site_verdict`` its verdict, ``matched`` the sorted names of the url rules
    that match.  A null URL and one without ``://`` have an empty host and path;
    url rules still apply to the latter.  Every URL is cut to tokens once; rules
    meet tokens in an equi-join that Spark broadcasts only if the rules are small.
    """
    spark = pages.sparkSession
    urls = pages.select(F.coalesce(F.col(url), F.lit("")).alias("u")).distinct()
    tokens = urls.select("u", F.explode(tokens_of(F.col("u"))).alias("token"))
    # a rule without literals is fetched by the empty token that every URL gets
    literals = spark.createDataFrame(
        [(i, t) for i, r in enumerate(rules) for t in (r.literals or [""])], "id int, token string"
    )
    seen = (
        tokens.join(literals.select("token").distinct(), "token").groupBy("token").agg(F.count("*").alias("n"))
    )
    rarest = (
        literals.join(seen, "token", "left")
        .groupBy("id")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token"))
    )
    body = spark.createDataFrame(
        [(i, r.name, r.verdict, r.scope, r.regex) for i, r in enumerate(rules)],
        "id int, name string, verdict string, scope string, regex string",
    )
    index = body.join(rarest, "id")
    fetched = tokens.join(index, "token")
    site = F.concat(host_of(F.col("u")), path_of(F.col("u")))
    subject = F.when(F.col("scope") == "site", site).otherwise(F.translate("u", UPPER, LOWER))
    hit = fetched.where(F.rlike(subject, F.col("regex")))
    of_site = F.when(
        F.col("scope") == "site", F.struct((-F.length("name")).alias("rank"), F.col("name"), F.col("verdict"))
    )
    judged = hit.groupBy("u").agg(
        F.min(of_site).alias("site"),
        F.sort_array(F.collect_set(F.when(F.col("scope") == "url", F.col("name")))).alias("matched"),
    )
    return urls.join(judged, "u", "left").select(
        "u",
        host_of(F.col("u")).alias("host"),
        path_of(F.col("u")).alias("path"),
        F.col("site")["name"].alias("rule"),
        F.col("site")["verdict"].alias("site_verdict"),
        F.coalesce("matched", F.array().cast("array<string>")).alias("matched"),
    )


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of the url of each row of ``pages``; null urls have an empty host and path, and are allowed."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = judge_urls(pages, SITES + WORDS)
    own = F.when(F.size("matched") > 0, F.lit("block")).otherwise(F.lit("allow"))
    return pages.join(judged, F.coalesce("url", F.lit("")) == F.col("u"), "left").select(
        "page_id", "host", "path", "rule", F.coalesce("site_verdict", own).alias("verdict")
    )


def _sql() -> str:
    words = " OR ".join(f"regexp_matches(low, '{r.regex}')" for r in WORDS)
    sites = " UNION ALL ".join(f"SELECT '{r.name}' AS name, '{r.verdict}' AS verdict" for r in SITES)
    return f"""
    WITH raw AS (SELECT page_id, coalesce(url, '') AS u FROM pages),
    rest AS (SELECT page_id, translate(u, '{UPPER}', '{LOWER}') AS low,
        CASE WHEN strpos(u, '://') > 0 THEN substr(u, strpos(u, '://') + 3) ELSE '' END AS r FROM raw),
    parts AS (SELECT page_id, low, translate(regexp_extract(r, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
        regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
    sites AS (SELECT name, verdict, split_part(name, '/', 1) AS h, substr(name, strpos(name, '/')) AS p FROM ({sites})),
    judged AS (SELECT page_id, low, host, path, (SELECT min(struct_pack(k := -length(name), n := name, v := verdict))
        FROM sites WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS s FROM parts)
    SELECT page_id, host, path, s.n AS rule,
        coalesce(s.v, CASE WHEN {words} THEN 'block' ELSE 'allow' END) AS verdict FROM judged"""


ORACLE_SQL = _sql()
