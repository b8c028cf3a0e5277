"""Personal data: base patterns, and terms that disclose them by corpus co-occurrence. DataFrame functions only.

Base spans are leftmost non-overlapping matches of the patterns for email, ip, card and phone. A distinct match is a
protected entity. A term (a word of three letters or more, lower-cased) near its mentions may give it away: the corpus
says how strongly, by the share of the entity's information content that the term carries,

    ratio(entity, term) = PMI(entity; term) / IC(entity)
                        = log(N df(entity, term) / (df(entity) df(term))) / log(N / df(entity)),

with df(entity, term) the documents where the term stands within `reach` characters of a mention, df(term) all documents
that have the term, and N all documents. A term at `least` or more is sanitised in the documents that mention the
entity near it. It is removed if the ratio is 1 (the term tells the entity for certain). Otherwise it is generalised to
the class of all terms that begin as it does, by its longest prefix whose class tells too little: a class with a member
in df documents has a ratio of log(N / df) / log(N / df(entity)) at most, whatever it occurs with. A term without such a
prefix becomes the class of all terms. A pair counts only if it was seen in `contexts` different surroundings, so copies
of one passage are one piece of evidence.

The patterns are written so that matching takes time linear in the text: a local part begins only where a run of its
characters or the search begins, and repeats don't give back characters. This changes no match.

Positions are code points, ends exclusive. Defined results: null and empty texts have no spans; rows with equal id and
text get equal spans; spans of different kinds may overlap and are replaced as one; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, written

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
#: For the card and phone kinds the pattern already asks for the number of digits of the whole match.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9](?:[ ().-]*+[0-9]){7,14}(?![ ().-]*+[0-9])",
}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
#: What a text must contain for the kind to be searched.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}
WORD = r"\p{L}{3,}"
HIDDEN = "[A-Za-z0-9._%+-]*@[A-Za-z0-9.-]*"  # what is near an address is judged without the address
SPAN = "array<struct<kind:int,start:int,end:int,value:string>>"


def _placed(text: Column, found: Column, pattern: str, kind: int, keep: Callable[[Column], Column] | None = None) -> Column:
    """Spans of the matches `found` (of those that are to be kept), from the lengths of what lies between them."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    steps = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(g.alias("gap"), m.alias("value")))
    first = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {SPAN})").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["value"])
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["value"].alias("value"))
        more = F.concat(acc["out"], F.array(span))
        return F.struct(end.alias("at"), (F.when(keep(x["value"]), more).otherwise(acc["out"]) if keep else more).alias("out"))

    return F.when(F.size(found) > 0, F.aggregate(steps, first, add, lambda acc: acc["out"])).otherwise(F.expr(f"cast(array() as {SPAN})"))


def base_spans(df: DataFrame, text_col: str = "text", out: str = "base") -> DataFrame:
    """df with a column of its base spans by kind as listed, then start."""
    text = F.col(text_col)
    names = {k: f"__{k}_{out}" for k in KINDS}
    none = F.expr("cast(array() as array<string>)")
    hits = {}
    for k in KINDS:
        there = text.isNotNull() if NEEDS[k] is None else F.coalesce(text.contains(NEEDS[k]), F.lit(False))
        hits[names[k]] = F.when(there, F.regexp_extract_all(text, F.lit(PATTERNS[k]), F.lit(0))).otherwise(none)
    df = df.withColumns(hits)
    spans = {k: _placed(text, F.col(names[k]), PATTERNS[k], i) for i, k in enumerate(KINDS)}
    spans["ip"] = F.filter(spans["ip"], lambda s: s["value"].rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"))
    spans["card"] = F.filter(spans["card"], lambda s: F.call_function("luhn_check", F.regexp_replace(s["value"], "[ -]", "")))
    return df.withColumn(out, F.concat(*(spans[k] for k in KINDS))).drop(*names.values())


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.transform(_words(text), F.lower))


def _prefixes(term: Column) -> Column:
    return F.explode(F.transform(F.sequence(F.lit(1), F.length(term) - 1), lambda n: F.left(term, n)))


def disclosing_terms(mentions: DataFrame, texts: DataFrame, least: float = 0.9, contexts: int = 3, reach: int = 80) -> DataFrame:
    """(id, key, term, form) for the documents and terms to sanitise; form: what takes the term's place.

    mentions: id, key, text, base; texts: all texts. The document frequency of every term of the corpus is counted
    first, with partial sums, so that each later join has a row for each term and not for each occurrence.
    """
    m = mentions.select("id", "key", "text", F.explode("base").alias("s"))
    # one character more than the window tells whether it cuts through a word; such a word is left out
    left = F.substring("text", F.greatest(F.col("s.start") - reach, F.lit(1)), F.least(F.col("s.start"), F.lit(reach + 1)))
    left = F.when(F.col("s.start") > reach, F.regexp_replace(left, r"^(?:\p{L}+|[^\p{L}])", " ")).otherwise(left)
    right = F.substring(F.col("text"), F.col("s.end") + 1, F.lit(reach + 1))
    right = F.when(F.length(right) > reach, F.regexp_replace(right, r"(?:\p{L}+|[^\p{L}])$", " ")).otherwise(right)
    around = F.regexp_replace(F.concat_ws(" ", left, right), HIDDEN, " ")
    near = m.select("id", "key", F.concat("s.kind", F.lit(":"), F.lower("s.value")).alias("entity"), F.xxhash64(around).alias("context"), _terms(around).alias("terms"))
    near = written(near, "mentions")
    seen = near.select("id", "key", "entity", "context", F.explode("terms").alias("term"))
    together = seen.groupBy("entity", "term").agg(F.count_distinct("context").alias("contexts"), F.count_distinct("id", "key").alias("both")).filter(F.col("contexts") >= contexts)
    together = written(together, "together")
    if together.isEmpty():
        return near.select("id", "key", F.lit("").alias("term"), F.lit("").alias("form")).limit(0)
    by_term = written(texts.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("of_term")), "frequencies")
    by_entity = near.select("id", "key", "entity").distinct().groupBy("entity").agg(F.count("*").alias("of_entity"))
    total = texts.agg(F.count("*").alias("total"))
    scored = together.join(by_term, "term").join(by_entity, "entity").crossJoin(F.broadcast(total))  # one row
    content = F.log(F.col("total") / F.col("of_entity"))
    ratio = F.when(content > 0, F.log(F.col("total") * F.col("both") / (F.col("of_entity") * F.col("of_term"))) / content)
    # a class of terms that occurs in more than `enough` documents tells less than the threshold, whatever it occurs with
    enough = F.col("total") * F.pow(F.col("of_entity") / F.col("total"), F.lit(least))
    told = written(scored.withColumn("ratio", ratio).filter(F.col("ratio") >= least).select("entity", "term", (F.col("ratio") >= 1 - 1e-9).alias("remove"), enough.alias("enough")), "told")
    lowest = told.filter(~F.col("remove")).agg(F.min("enough").alias("lowest"))  # one row
    common = by_term.join(F.broadcast(lowest), F.col("of_term") > F.col("lowest")).filter(F.length("term") > 1)
    common = common.select(_prefixes(F.col("term")).alias("prefix"), "of_term").groupBy("prefix").agg(F.max("of_term").alias("widest"))
    wide = told.filter(~F.col("remove")).select("entity", "term", "enough", _prefixes(F.col("term")).alias("prefix")).join(common, "prefix").filter(F.col("widest") > F.col("enough"))
    wide = wide.groupBy("entity", "term").agg(F.max(F.length("prefix")).alias("size"))
    told = told.join(wide, ["entity", "term"], "left").withColumn("size", F.when(F.col("remove"), -1).otherwise(F.coalesce("size", F.lit(0)))).select("entity", "term", "size")
    chosen = seen.join(told, ["entity", "term"]).groupBy("id", "key", "term").agg(F.min("size").alias("size"))
    form = F.when(F.col("size") < 0, "").when(F.col("size") == 0, LABELS["term"]).otherwise(F.concat(F.expr("left(term, size)"), F.lit("*")))
    return chosen.select("id", "key", "term", form.alias("form"))


def find_private(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "private", forms: str = "term_forms", **how) -> DataFrame:
    """df with `out`: base spans by kind and start, then term spans (kind 4) by start; and `forms`: terms and what takes their place."""
    df = df.drop(out, forms)
    given, (id_col, text_col) = df.columns, (f"given{df.columns.index(c)}" for c in (id_col, text_col))
    df = df.toDF(*(f"given{i}" for i in range(len(given))))  # no column of df has a name that is used here
    named = {f"given{i}": c for i, c in enumerate(given)}
    back = lambda x: x.select(*(F.col(k).alias(c) for k, c in named.items()), out, forms)
    texts = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    terms = disclosing_terms(base_spans(texts).filter(F.size("base") > 0), texts.select("text"), **how)
    by_row = written(terms.groupBy(F.col("id").alias("__id"), F.col("key").alias("__key")).agg(F.map_from_entries(F.collect_list(F.struct("term", "form"))).alias("__forms")), "terms")
    found = base_spans(df.withColumns({"__id": F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)), "__key": F.xxhash64(text_col)}), text_col, out)
    nothing = F.expr("cast(map() as map<string,string>)")
    if by_row.isEmpty():
        return back(found.withColumn(forms, nothing))
    found = found.join(by_row, ["__id", "__key"], "left")
    hits = F.when(F.col("__forms").isNotNull(), _words(F.col(text_col))).otherwise(F.expr("cast(array() as array<string>)"))
    found = found.withColumn("__words", hits)
    extra = _placed(F.col(text_col), F.col("__words"), WORD, len(KINDS), lambda w: F.map_contains_key(F.col("__forms"), F.lower(w)))
    free = F.filter(extra, lambda t: ~F.exists(out, lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    return back(found.withColumns({out: F.concat(out, free), forms: F.coalesce("__forms", nothing)}))


def sanitise(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """df with its texts' private spans replaced by their kind's label, and terms by their broader form or nothing; all columns are kept."""
    given, (id_col, text_col) = df.columns, (f"given{df.columns.index(c)}" for c in (id_col, text_col))
    found = find_private(df.toDF(*(f"given{i}" for i in range(len(given)))), id_col, text_col, "private", "term_forms", **how)
    text, spans = F.col(text_col), F.col("private")
    spans = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    label = lambda s: F.element_at(F.array(*map(F.lit, LABELS.values())), s["kind"] + 1)
    first = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))

    def add(acc: Column, s: Column) -> Column:
        put = F.coalesce(F.when(s["kind"] == len(KINDS), F.col("term_forms")[F.lower(s["value"])]), label(s))
        fresh = s["start"] >= acc["at"]
        joined = F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), put))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, joined).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate(spans, first, add, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return found.withColumn(text_col, F.when(F.size("private") > 0, clean).otherwise(text)).drop("private", "term_forms").toDF(*given)


def as_text(spans: Column) -> Column:
    names = F.array(*map(F.lit, LABELS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def brute_force(text: str | None) -> list[tuple[str, int, int]]:
    """Base spans with the patterns as they are stated, for tests."""
    import re

    stated = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, pattern in stated.items():
        for m in re.finditer(pattern, text or "", re.ASCII):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and (not 16 <= len(digits) <= 19 or sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(digits[::-1])) % 10):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def brute_force_terms(rows: list[tuple[int, str | None]], least: float = 0.9, contexts: int = 3, reach: int = 80) -> dict[tuple[int, str], str]:
    """What takes the place of each term to sanitise, by document, for tests."""
    import math
    from collections import Counter, defaultdict

    import regex

    words = lambda t: {w.lower() for w in regex.findall(WORD, t or "")}
    df = Counter(w for _, t in rows for w in words(t))
    where, surroundings, of_entity = defaultdict(set), defaultdict(set), defaultdict(set)
    for i, t in rows:
        for kind, start, end in brute_force(t):
            left, right = t[max(0, start - reach - 1) : start], t[end : end + reach + 1]
            left = regex.sub(r"^(?:\p{L}+|[^\p{L}])", " ", left) if start > reach else left
            right = regex.sub(r"(?:\p{L}+|[^\p{L}])$", " ", right) if len(right) > reach else right
            near, entity = regex.sub(HIDDEN, " ", f"{left} {right}"), (kind, t[start:end].lower())
            of_entity[entity].add((i, t))
            for w in words(near):
                where[entity, w].add((i, t))
                surroundings[entity, w].add(near)
    n, out = len(rows), {}
    for (entity, w), docs in where.items():
        content = math.log(n / len(of_entity[entity]))
        if len(surroundings[entity, w]) < contexts or content <= 0:
            continue
        ratio = math.log(n * len(docs) / (len(of_entity[entity]) * df[w])) / content
        if ratio >= least:
            prefixes = [w[:k] for k in range(1, len(w)) if max(c for x, c in df.items() if x.startswith(w[:k]) and len(x) > k) > n * (len(of_entity[entity]) / n) ** least]
            size = -1 if ratio >= 1 - 1e-9 else max(map(len, prefixes), default=0)
            for i, _ in docs:
                out[i, w] = min(size, out.get((i, w), size))
    return {(i, w): "" if k < 0 else LABELS["term"] if not k else w[:k] + "*" for (i, w), k in out.items()}
