"""Operator 7, personal data: regular expressions propose spans, checksums confirm them, words nearby adjust the score.

DataFrame functions only. Places come from splitting a text at the matches: the lengths of the pieces and of the matches, added up, give each
start and end in code points. Patterns begin where the last match ended or after a character that couldn't belong to the match (the same
leftmost matches, without a new attempt at each place of a long run) and are possessive where that changes nothing. Places are added up in
chunks of CHUNK matches and then over the chunks, and the characters before a match are put together from the ends of the pieces and matches
just before it, so the text itself isn't gone through again for each match. A kind whose sign (`@`, `+`, a digit) a text lacks is skipped.

Base kinds: email, ip (parts at most 255), card (16 to 19 digits that pass Luhn), phone (8 to 15 digits); matches that fail are dropped. The
method adds iban (mod-97) and ssn (three, two and four digits, only with a word for it nearby). Each span has a score: 0.5 for a form
alone, 0.9 with a checksum, and 0.1 more (up to 1) if a word for its kind stands within WINDOW characters before it.

Cases: a null text is empty and has no spans; identifiers may be null or repeated, rows aren't merged; extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters before a span in which its words count; the most matches that these can touch (a match has two characters at least); matches of a chunk.
WINDOW, CHUNK = 48, 256
TOUCH = WINDOW // 2
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
BASE = ("email", "ip", "card", "phone")
#: kind: (pattern, what a text must hold, words nearby)
KINDS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", "e-?mail|contact|write to"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", "ip|address|host|server"),
    "card": (r"[0-9](?:[ -]?[0-9])++", "[0-9]", "card|credit|visa|payment"),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]", "phone|call|tel|mobile"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])", "[A-Z][A-Z][0-9][0-9]", "iban|account|bank"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]-[0-9]", "ssn|social security"),
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn."""
    doubled = F.array(*(F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)))
    each = F.transform(F.split(F.reverse(number), ""), lambda d, i: F.when(d == "", 0).when(i % 2 == 1, F.get(doubled, d.cast("int"))).otherwise(d.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number (A-Z and digits) is 1 modulo 97 after its first four characters go to the end."""
    plain = F.regexp_replace(account, " ", "")
    values = F.transform(F.split(F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4)), ""), lambda c: F.when(c == "", -1).when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    return F.aggregate(values, F.lit(0), lambda a, x: F.when(x < 0, a).when(x < 10, (a * 10 + x) % 97).otherwise((a * 100 + x) % 97)) == 1


def confirmed(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        number = digits(match)
        return F.length(number).between(16, 19) & luhn(number)
    if kind == "phone":
        return F.length(digits(match)).between(8, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(match, " ", "")).between(15, 34) & mod97(match)
    return F.lit(True)


def _ends(c: Column) -> Column:
    return F.when(F.length(c) > WINDOW, F.substring(c, -WINDOW, WINDOW)).otherwise(c)


def _places(turns: Column) -> Column:
    """Starts of the matches: pieces and matches take turns, each moves the place on."""
    none, nones = F.array().cast("array<int>"), F.array().cast("array<array<int>>")
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(turns) - 1) / CHUNK).cast("int")), lambda k: F.slice(turns, k * CHUNK + 1, CHUNK))
    step = lambda a, x: F.struct((a["at"] + x["gap"] + x["size"]).alias("at"), F.concat(a["starts"], F.array(a["at"] + x["gap"])).alias("starts"))
    inside = F.transform(chunks, lambda c: F.aggregate(c, F.struct(F.lit(0).alias("at"), none.alias("starts")), step))
    move = lambda a, x: F.struct((a["at"] + x["at"]).alias("at"), F.concat(a["starts"], F.array(F.transform(x["starts"], lambda s: s + a["at"]))).alias("starts"))
    return F.flatten(F.aggregate(inside, F.struct(F.lit(0).alias("at"), nones.alias("starts")), move)["starts"])


def _nearby(tails: Column, i: Column) -> Column:
    """The last WINDOW characters before match i, lower-cased."""
    since = F.greatest(i - TOUCH, F.lit(0))
    earlier = F.transform(F.slice(tails, since + 1, i - since), lambda x: F.concat(x["p"], x["m"]))
    return F.lower(_ends(F.concat(F.array_join(earlier, ""), F.get(tails, i)["p"])))


def _each(text: Column, kind: str, body: Callable[[Column, Column], Column]) -> Column:
    """body of the pieces (the part after the last match too) and of an array with, for each match, its text, start, and score (null where it is
    dropped); null where the text has no match."""
    pattern, sign, words = KINDS[kind]
    base = {"card": 0.9, "iban": 0.9}.get(kind, 0.5)

    def judged(found: Column, pieces: Column, starts: Column, tails: Column) -> Column:
        def one(m: Column, i: Column) -> Column:
            near = _nearby(tails, i).rlike(rf"\b(?:{words})\b")
            score = F.when(near, F.lit(base + 0.1)) if kind == "ssn" else F.when(near, F.lit(base + 0.1)).otherwise(F.lit(base))
            return F.struct(m.alias("match"), F.get(starts, i).alias("start"), F.when(confirmed(kind, m), score).alias("score"))

        return let(F.transform(found, one), lambda marks: body(pieces, marks))

    def placed(found: Column, pieces: Column) -> Column:
        turns = F.arrays_zip(F.transform(F.slice(pieces, 1, F.size(found)), F.length).alias("gap"), F.transform(found, F.length).alias("size"))
        tails = F.transform(F.arrays_zip(F.slice(pieces, 1, F.size(found)).alias("p"), found.alias("m")), lambda x: F.struct(_ends(x["p"]).alias("p"), _ends(x["m"]).alias("m")))
        return let(turns, lambda t: let(_places(t), lambda starts: let(tails, lambda ends: judged(found, pieces, starts, ends))))

    some = lambda found: F.when(F.size(found) > 0, let(F.split(text, pattern, -1), lambda pieces: placed(found, pieces)))
    return F.when(text.rlike(sign), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), some))


def spans(text: Column, kind: str) -> Column:
    """Array of (start, end, score) of a kind, in order; end is exclusive."""
    kept = lambda _, marks: F.transform(F.filter(marks, lambda m: m["score"].isNotNull()), lambda m: F.struct(m["start"].alias("start"), (m["start"] + F.length(m["match"])).alias("end"), m["score"].alias("score")))
    return F.coalesce(_each(text, kind, kept), F.array().cast("array<struct<start:int,end:int,score:double>>"))


def _cut(text: Column, kind: str) -> Column:
    """The text with each span of a kind replaced."""

    def joined(pieces: Column, marks: Column) -> Column:
        parts = F.transform(marks, lambda m, i: F.concat(F.get(pieces, i), F.when(m["score"].isNotNull(), F.lit(f"[{kind}]")).otherwise(m["match"])))
        return F.concat(F.array_join(parts, ""), F.get(pieces, F.size(marks)))

    return F.coalesce(_each(text, kind, joined), text)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the text and one array of spans (start, end, score) for each kind. No shuffle."""
    held = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return held.select("id", "text", *(spans(F.col("text"), k).alias(k) for k in KINDS))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[str, ...] = tuple(KINDS)) -> DataFrame:
    """id and the text with each span of the kinds replaced by its kind in brackets, later kinds after earlier ones."""
    out = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    for k in kinds:
        out = out.withColumn("text", _cut(F.col("text"), k))
    return out


def _joined(kinds: tuple[str, ...]) -> Column:
    def one(kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))

    return F.array_join(F.concat(*map(one, kinds)), ",")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    best = F.aggregate(F.concat(*(F.transform(F.col(k), lambda s: s["score"]) for k in KINDS)), F.lit(0.0), lambda a, x: F.greatest(a, x))
    return found.select(F.col("id").alias("doc_id"), *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE), F.sha2(_joined(BASE), 256).alias("base_sha256"), _joined(tuple(KINDS)).alias("spans"), best.alias("top_score"))


def _sql() -> str:
    """The same in DuckDB SQL: its expressions have neither look-behind nor possessive repeats, so base kinds use the plain patterns, and the
    others take the character before into the match and leave it out again."""
    octet = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "card": r"[0-9](?:[ -]?[0-9])+",
        "phone": r"\+[0-9][ ().0-9-]+[0-9]",
        "iban": r"(?:^|[^A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}\b|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?\b)",
        "ssn": r"(?:^|[^0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    }
    digit = "regexp_replace(w, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(0, length({digit})), lambda j: case when j % 2 = 1 then [0,2,4,6,8,1,3,5,7,9][1 + cast(substr({digit}, length({digit}) - j, 1) as integer)] else cast(substr({digit}, length({digit}) - j, 1) as integer) end)) % 10 = 0"
    moved = "substr(replace(w, ' ', ''), 5) || substr(replace(w, ' ', ''), 1, 4)"
    numbers = f"array_to_string(list_transform(string_split({moved}, ''), lambda c: case when c between '0' and '9' then c else cast(ascii(c) - 55 as varchar) end), '')"
    rest = f"list_reduce(list_transform(string_split({numbers}, ''), lambda c: cast(c as integer)), lambda a, x: (a * 10 + x) % 97, 0) = 1"
    passes = {"email": "true", "ip": rf"regexp_full_match(w, '{octet}(?:\.{octet}){{3}}')", "card": f"length({digit}) between 16 and 19 and {luhn}", "phone": f"length({digit}) between 8 and 15", "iban": f"length(replace(w, ' ', '')) between 15 and 34 and {rest}", "ssn": "true"}
    parts = []
    for n, kind in enumerate(KINDS):
        base = 0.9 if kind in ("card", "iban") else 0.5
        words = KINDS[kind][2]
        lead = "[A-Z0-9]" if kind in ("iban", "ssn") else "."
        skip = f"case when regexp_matches(m[i], '^{lead}') then 0 else 1 end" if kind in ("iban", "ssn") else "0"
        parts.append(
            f"select id, t, {n} as k, '{kind}' as kind, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'w': substr(m[i], 1 + {skip}), 'a': cast(list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) + {skip} as bigint)}}), recursive := true), {base}::double as base, '{words}' as words from (select id, t, regexp_extract_all(t, '{plain[kind]}') as m, string_split_regex(t, '{plain[kind]}') as s from d)"
        )
    checks = " or ".join(f"(kind = '{k}' and {p})" for k, p in passes.items())
    found = f"select id, k, kind, a, a + length(w) as e, case when regexp_matches(lower(substr(t, greatest(a - {WINDOW}, 0) + 1, least(a, {WINDOW}))), '\\b(?:' || words || ')\\b') then base + 0.1 else base end as score from ({' union all '.join(parts)}) where {checks}"
    spans = "coalesce(string_agg(kind || ':' || a || ':' || e, ',' order by k, a){0}, '')"
    return (
        f"with d as (select row_number() over () as id, doc_id, coalesce(text, '') as t from documents), f as ({found}), g as (select * from f where kind <> 'ssn' or score > 0.5) "
        "select d.doc_id, " + ", ".join(f"count(kind) filter (kind = '{k}') as n_{k}" for k in BASE) + f", sha256({spans.format(' filter (k < 4)')}) as base_sha256, {spans.format('')} as spans, coalesce(max(score), 0)::double as top_score from d left join g on d.id = g.id group by d.id, d.doc_id"
    )


OP7_SQL = _sql()
