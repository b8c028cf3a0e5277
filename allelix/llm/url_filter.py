r"""URL filters: site rules by host and path, and pattern rules indexed by their rarest literal token.

A pattern rule is a regular expression over the URL; case counts in neither, and classes such as \w are ASCII. Literal
tokens are the whole alphanumeric words that every match must contain. Each rule is filed under the one of its tokens
that is rarest in the given URLs (counted over all of them), so a URL's own tokens fetch the few rules that can match,
and only those run. A rule without a literal token is tried on every URL. Rules are a parameter and travel to the
workers; their total size is checked.

Site rules (host, path) fit a host and its subdomains if the URL's path starts with the rule's path; the longest wins
and decides. Where none fits, the verdict is block if a pattern rule matches and allow otherwise.

Defined results: a URL that is null or has no `://` has empty host and path and is judged by the patterns alone (null:
allow); the rows of a table with repeated URLs are judged alike; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as sre
from re import _parser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_RULE_BYTES = 64 << 20
TOKEN = re.compile("[a-z0-9]+")
PARTS = re.compile(r"(?s).*?://([^/?#]*)([^?#]*)")
FLAGS = re.IGNORECASE | re.ASCII
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@dataclass(frozen=True)
class SiteRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Fixed values of the registered query.
SITE_RULES = (SiteRule("allow", "com", "/"), SiteRule("block", "example.com", "/en/"), SiteRule("allow", "www.example.com", "/en/"), SiteRule("block", "net", "/es/"), SiteRule("block", "net", "/fr/"))
PATTERN_RULES = (
    r"://([^/?#]*\.)?spam-farm\.",
    r"://([^/?#]*\.)?free-bets\.",
    r"://([^/?#]*[.-])?casino[.-]",
    r"[/.-]porn[/.-]",
    r"/wp-login\.php\b",
    r"/cgi-bin/",
    r"[?&]sessionid=",
    r"\.(exe|zip|iso)([?#]|$)",
)


def literal_tokens(pattern: str) -> set[str]:
    """Whole alphanumeric words, lower-cased, that every URL matched by the pattern contains."""
    found, run, closed = set(), "", False
    items = [*_parser.parse(pattern, FLAGS), None]
    alike = lambda code: TOKEN.fullmatch(chr(code).translate(LOWER))

    def edge(item) -> bool:
        """Whether no alphanumeric character can stand there."""
        if item is None:
            return False
        op, value = item
        if op is sre.LITERAL:
            return not alike(value)
        if op is sre.IN:
            return all(o is sre.LITERAL and not alike(v) for o, v in value)
        return op is sre.AT and value in (sre.AT_BEGINNING, sre.AT_BEGINNING_STRING, sre.AT_END, sre.AT_END_STRING, sre.AT_BOUNDARY)

    for item in items:
        if item is not None and item[0] is sre.LITERAL and alike(item[1]):
            run += chr(item[1]).translate(LOWER)
            continue
        if run and closed and edge(item):
            found.add(run)
        run, closed = "", edge(item)
    return found


class RuleIndex:
    def __init__(self, sites: tuple[SiteRule, ...], patterns: tuple[str, ...], counts: dict[str, int]):
        self.patterns = [re.compile(p, FLAGS) for p in patterns]
        self.by_token: dict[str, list[int]] = {}
        self.always: list[int] = []
        for i, p in enumerate(patterns):
            tokens = literal_tokens(p)
            (self.by_token.setdefault(min(tokens, key=lambda t: (counts.get(t, 0), t)), []) if tokens else self.always).append(i)
        self.sites: dict[str, list[SiteRule]] = {}
        for s in sorted(sites, key=lambda s: (-len(s.name), s.name)):
            self.sites.setdefault(s.host, []).append(s)

    def judge(self, url: str | None) -> tuple[str, str, str | None, str, str | None]:
        m = PARTS.match(url) if url is not None else None
        host, path = (m[1].translate(LOWER), m[2]) if m else ("", "")
        best, at = None, 0 if m else -1
        while at >= 0:
            for s in self.sites.get(host[at:], ()):
                if path.startswith(s.path):
                    best = s if best is None or len(s.name) > len(best.name) else best
                    break
            dot = host.find(".", at)
            at = dot + 1 if dot >= 0 else -1
        hit = None
        if url is not None:
            low = url.translate(LOWER)
            rules = {i for t in set(TOKEN.findall(low)) for i in self.by_token.get(t, ())}
            hit = next((i for i in sorted([*rules, *self.always]) if self.patterns[i].search(low)), None)
        verdict = best.verdict if best else "allow" if hit is None else "block"
        return host, path, best.name if best else None, verdict, None if hit is None else self.patterns[hit].pattern


def filter_urls(df: DataFrame, sites: tuple[SiteRule, ...] = SITE_RULES, patterns: tuple[str, ...] = PATTERN_RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of df: its id, host, path, rule, verdict, pattern (the first pattern rule that matches)."""
    size = sum(map(len, patterns)) + sum(len(s.name) for s in sites)
    if size > MOST_RULE_BYTES:
        raise ValueError(f"{size} bytes of rules; give them in lists of {MOST_RULE_BYTES} at most")
    spark = df.sparkSession
    tokens = sorted(set().union(*map(literal_tokens, patterns)))
    counts = {}
    if tokens:
        wanted = F.broadcast(spark.createDataFrame([(t,) for t in tokens], "token string"))  # at most as large as the rules
        seen = df.select(F.explode(F.array_distinct(F.expr(f"regexp_extract_all(lower(`{url_col}`), '[a-z0-9]+', 0)"))).alias("token"))
        counts = {r["token"]: r["count"] for r in seen.join(wanted, "token").groupBy("token").count().collect()}

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = RuleIndex(sites, patterns, counts)
        for batch in batches:
            found = [index.judge(u) for u in batch.column("url").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array([f[k] for f in found], pa.string()) for k in range(5))], [id_col, "host", "path", "rule", "verdict", "pattern"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).mapInArrow(judge, f"`{id_col}` {kind}, host string, path string, rule string, verdict string, pattern string")


def oracle(sites: tuple[SiteRule, ...] = SITE_RULES, patterns: tuple[str, ...] = PATTERN_RULES) -> str:
    """The registered query in DuckDB's SQL: every rule is tried on every URL."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    fits = lambda s: f"(host = {text(s.host)} or ends_with(host, {text('.' + s.host)})) and starts_with(path, {text(s.path)})"
    by_length = sorted(sites, key=lambda s: (-len(s.name), s.name))
    case = lambda what: "case " + " ".join(f"when {fits(s)} then {text(what(s))}" for s in by_length)
    hit = "case " + " ".join(f"when regexp_matches(low, {text(p)}) then {text(p)}" for p in patterns) + " end"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    parts = r"'(?s)^.*?://([^/?#]*)([^?#]*)'"
    return f"""
with p as (select page_id, translate(url, '{upper}', '{lower}') as low,
                  translate(coalesce(regexp_extract(url, {parts}, 1), ''), '{upper}', '{lower}') as host,
                  coalesce(regexp_extract(url, {parts}, 2), '') as path from pages),
     q as (select *, {hit} as pattern from p)
select page_id, host, path, {case(lambda s: s.name)} end as rule,
       {case(lambda s: s.verdict)} when pattern is not null then 'block' else 'allow' end as verdict, pattern
from q"""
