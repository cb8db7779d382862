"""Personal data in texts: patterns propose spans, checksums confirm them, context words move the score.

Everything is a Spark column: there is no shuffle and no Python in the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

KINDS = ("email", "ip", "card", "phone", "iban", "dni", "ssn", "routing", "secret")
BASE_KINDS = KINDS[:4]

# Each pattern finds the leftmost non-overlapping matches of the plain form in the comment. The anchor
# in front lets a match start only where a run of characters begins or where the last match ended, and
# possessive repeats do not back up: neither changes what is found, both keep long runs linear.
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # country, two check digits, groups of four, a rest of up to three
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    # Spanish identity number: eight digits and a check letter
    "dni": r"(?<![A-Za-z0-9_])[0-9]{8}-?[A-Z](?![A-Za-z0-9_])",
    # US social security number
    "ssn": r"(?<![A-Za-z0-9_])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_])",
    # US bank routing number
    "routing": r"(?<![A-Za-z0-9_])[0-9]{9}(?![A-Za-z0-9_])",
    # a credential that is given to its name
    "secret": r"""(?i:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key)["']?\x20{0,3}[:=]\x20{0,3}["']?[A-Za-z0-9+/_.~-]{16,}={0,2}""",
}

# A text without this cannot hold a match, so the patterns need not run.
_NEEDS = {"email": "@", "ip": ".", "phone": "+"}
_NEEDS_FORM = {
    "card": r"[0-9][\x20-]?[0-9]", "iban": "[0-9][0-9]", "dni": "[0-9]{8}-?[A-Z]", "ssn": "[0-9]-[0-9]{2}-[0-9]",
    "routing": "[0-9]{9}", "secret": "[:=]",
}

# The check letters of Spanish identity numbers by the number modulo 23.
_DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"

# Words near a span that make it likelier to be personal data of that kind.
CONTEXT = {
    "email": "mail|contact|write|reach|correo|courriel|kontakt",
    "ip": "address|host|server|client|login|logged|visitor",
    "card": "card|visa|credit|payment|charge|karte|carte|tarjeta",
    "phone": "phone|call|mobile|tel|fax|contact|ruf|appel|llam",
    "iban": "iban|bank|account|transfer|konto|compte|cuenta",
    "dni": "dni|nif|identi|documento",
    "ssn": "ssn|social|security|taxpayer",
    "routing": "routing|aba|bank|transfer|wire",
    "secret": "auth|login|header|curl|export|config|env",
}
_PRIOR = {
    "email": 0.8, "ip": 0.5, "card": 0.75, "phone": 0.6, "iban": 0.85, "dni": 0.6, "ssn": 0.4, "routing": 0.4, "secret": 0.7
}
_LIFT = 0.15
# Spans below this are not personal data: kinds that numbers of other meanings often pass need a context word.
KEEP_SCORE = 0.5
_NEAR = 40
_BLOCK = 64

SPAN = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _mod97(match: Column) -> Column:
    """ISO 7064 remainder: the first four characters go last, A is 10 to Z is 35."""
    plain = F.regexp_replace(match, " ", "")
    moved = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))
    return F.aggregate(
        F.regexp_extract_all(moved, F.lit("."), F.lit(0)),
        F.lit(0),
        lambda rest, c: F.when(c.between("0", "9"), (rest * 10 + F.ascii(c) - 48) % 97)
        .otherwise((rest * 100 + F.ascii(c) - 55) % 97)
        .cast("int"),
    )


def valid(kind: str, match: Column) -> Column:
    """Whether a match passes the checks of its kind."""
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        digits = _digits(match)
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(match, " ", "")).between(15, 34) & (_mod97(match) == 1)
    if kind == "dni":
        digits = F.left(match, F.lit(8)).cast("int")
        return F.substr(F.lit(_DNI_LETTERS), digits % 23 + 1, F.lit(1)) == F.right(match, F.lit(1))
    if kind == "ssn":
        # Areas, groups and serial numbers that are never given out.
        return ~match.rlike("^(?:000|666|9)|-00-|-0000$")
    if kind == "routing":
        digit = lambda i: F.substr(match, F.lit(i), F.lit(1)).cast("int")
        weighed = sum((digit(i) * (3, 7, 1)[(i - 1) % 3] for i in range(2, 10)), digit(1) * 3)
        return match.rlike("^(?:0[0-9]|1[0-2]|2[1-9]|3[0-2]|6[1-9]|7[0-2]|80)") & (weighed % 10 == 0)
    if kind == "secret":
        value = F.regexp_extract(match, "[A-Za-z0-9+/_.~-]{16,}={0,2}$", 0)
        varied = F.size(F.array_distinct(F.split(value, ""))) >= 8
        return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & varied
    return F.lit(True)


def _candidates(text: Column, kind: str) -> Column:
    return F.contains(text, F.lit(_NEEDS[kind])) if kind in _NEEDS else text.rlike(_NEEDS_FORM[kind])


def _hits(text: Column, kind: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    return F.when(_candidates(text, kind), found).otherwise(F.array().cast("array<string>"))


def _pieces(text: Column, hits: Column, kind: str) -> Column:
    """The texts around the hits, one more than hits."""
    return F.when(F.size(hits) > 0, F.split(text, PATTERNS[kind], -1)).otherwise(F.array(text))


def _located(hits: Column, pieces: Column, steps: Column, sums: Column, kind: str) -> Column:
    """Spans of valid hits. ``steps``: length of piece and hit; ``sums``: the same per block of steps."""

    def total(lengths: Column) -> Column:
        return F.aggregate(lengths, F.lit(0).cast("bigint"), lambda a, x: a + x)

    def span(hit: Column, i: Column) -> Column:
        block = (i / F.lit(_BLOCK)).cast("int")
        before = total(F.slice(sums, F.lit(1), block)) + total(
            F.slice(steps, block * _BLOCK + 1, i - block * _BLOCK)
        )
        piece = F.element_at(pieces, i + 1)
        start = before + F.length(piece)
        near = F.lower(F.concat_ws(" ", F.right(piece, F.lit(_NEAR)), F.left(F.element_at(pieces, i + 2), F.lit(_NEAR))))
        lift = F.when(near.rlike(CONTEXT[kind]), _LIFT).otherwise(0.0)
        score = F.lit(_PRIOR[kind]) + lift
        return F.when(
            valid(kind, hit) & (score >= KEEP_SCORE),
            F.struct(
                F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(hit)).alias("end"), score.alias("score")
            ),
        )

    spans = F.filter(F.transform(hits, span), lambda s: s.isNotNull())
    return F.when(F.size(hits) > 0, spans).otherwise(F.array()).cast(SPAN)


def find_pii(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """Add the array of personal-data spans of a text column.

    A span is (kind, start, end, score): code points from 0, end exclusive. Spans come by kind in
    the order of ``KINDS`` and then by start. E-mail addresses, IP addresses, card numbers (Luhn)
    and phone numbers are the base kinds. Found besides, and free to overlap them: IBANs (mod 97), Spanish
    identity numbers (mod 23), US social security numbers (ranges) and bank routing numbers (3-7-1),
    and credentials given to their name (letters and digits, at least eight different characters).
    The score is a prior of the kind, raised when a context word stands within 40 code points
    before or after the span, up to the neighbouring hit of the same kind. Spans that score less
    than ``KEEP_SCORE`` are dropped: social security and routing numbers without a context word.

    A null or empty text has an empty array. Repeated rows and extra columns pass through; a
    column already named ``out`` is replaced. Texts are scanned whole, whatever their length.
    """
    kept = [F.col(f"row.{_quoted(c)}") for c in docs.columns if c != out]
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(_quoted(text)), F.lit("")).alias("text"))
    # One projection each, so that every pattern runs once per text.
    rows = rows.select("*", *[_hits(F.col("text"), k).alias(f"h_{k}") for k in KINDS])
    rows = rows.select("*", *[_pieces(F.col("text"), F.col(f"h_{k}"), k).alias(f"p_{k}") for k in KINDS])
    rows = rows.select("*", *[_steps(F.col(f"h_{k}"), F.col(f"p_{k}")).alias(f"l_{k}") for k in KINDS])
    rows = rows.select("*", *[_block_sums(F.col(f"l_{k}")).alias(f"s_{k}") for k in KINDS])
    spans = [_located(F.col(f"h_{k}"), F.col(f"p_{k}"), F.col(f"l_{k}"), F.col(f"s_{k}"), k) for k in KINDS]
    return rows.select(*kept, F.concat(*spans).alias(out))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _steps(hits: Column, pieces: Column) -> Column:
    lengths = F.transform(hits, lambda h, i: (F.length(h) + F.length(F.element_at(pieces, i + 1))).cast("bigint"))
    return F.when(F.size(hits) > 0, lengths).otherwise(F.array().cast("array<bigint>"))


def _block_sums(steps: Column) -> Column:
    blocks = F.sequence(F.lit(0), ((F.size(steps) - 1) / F.lit(_BLOCK)).cast("int"))
    sums = F.transform(
        blocks,
        lambda b: F.aggregate(F.slice(steps, b * _BLOCK + 1, _BLOCK), F.lit(0).cast("bigint"), lambda a, x: a + x),
    )
    return F.when(F.size(steps) > 0, sums).otherwise(F.array().cast("array<bigint>"))


def _largest_before(ends: Column, blocks: Column, i: Column) -> Column:
    """Largest of the first ``i`` ends, 0 for none. ``blocks``: the largest of each block of ends."""
    block = (i / F.lit(_BLOCK)).cast("int")
    whole = F.array_max(F.slice(blocks, F.lit(1), block))
    rest = F.array_max(F.slice(ends, block * _BLOCK + 1, i - block * _BLOCK))
    return F.coalesce(F.greatest(whole, rest), F.lit(0).cast("bigint"))


def _block_numbers(items: Column) -> Column:
    return F.sequence(F.lit(0), ((F.size(items) - 1) / F.lit(_BLOCK)).cast("int"))


def _widest_kind(spans: Column, first: Column, after: Column) -> Column:
    width = F.transform(
        F.slice(spans, first + 1, after - first), lambda s: F.struct((s["end"] - s["start"]).alias("width"), s["kind"].alias("kind"))
    )
    return F.array_max(width)["kind"]


def mask_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace every span of ``find_pii`` in the text column by its kind in brackets, such as ``[EMAIL]``.

    All spans are those of the text as it came in. Spans that overlap are cut out as one, under the
    kind of the widest of them, so nothing of a span stays. Nulls stay null; all other columns pass
    through in their order.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col(_quoted(text)).alias("text"))
    rows = find_pii(rows).withColumn(
        "spans", F.sort_array(F.transform("pii", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    )
    rows = rows.select("row", "text", "spans", F.col("spans.end").alias("ends"))
    largest = F.transform(_block_numbers(F.col("ends")), lambda b: F.array_max(F.slice("ends", b * _BLOCK + 1, _BLOCK)))
    rows = rows.withColumn("blocks", F.when(F.size("ends") > 0, largest).otherwise(F.array().cast("array<bigint>")))
    # Where a merged span starts: no span before it reaches beyond. ``before`` is the end of the merged span before.
    starts = F.transform(
        "spans",
        lambda s, i: F.struct(
            i.alias("i"), s["start"].alias("start"), _largest_before(F.col("ends"), F.col("blocks"), i).alias("before")
        ),
    )
    rows = rows.withColumn("starts", starts)
    rows = rows.withColumn("heads", F.filter("starts", lambda s: s["start"] >= s["before"])).drop("starts")
    heads = F.col("heads")

    # Texts are cut in blocks of spans first, so that no cut has to count from the start of a long text.
    def cut(b: Column) -> Column:
        start = F.get(heads, b * _BLOCK)["before"]
        stop = F.coalesce(F.get(heads, (b + 1) * _BLOCK)["before"], F.length("text").cast("bigint"))
        return F.substr(F.col("text"), (start + 1).cast("int"), (stop - start).cast("int"))

    some = F.size("heads") > 0
    rows = rows.withColumn("cuts", F.when(some, F.transform(_block_numbers(heads), cut)).otherwise(F.array().cast("array<string>")))

    def filled(head: Column, k: Column) -> Column:
        block = (k / F.lit(_BLOCK)).cast("int")
        at = head["before"] - F.get(heads, block * _BLOCK)["before"]
        kept = F.substr(F.get("cuts", block), (at + 1).cast("int"), (head["start"] - head["before"]).cast("int"))
        after = F.coalesce(F.get(heads, k + 1)["i"], F.size("spans"))
        return F.concat(kept, F.lit("["), F.upper(_widest_kind(F.col("spans"), head["i"], after)), F.lit("]"))

    rest = F.substr(F.col("text"), (F.array_max("ends") + 1).cast("int"))
    new = F.when(some, F.concat(F.array_join(F.transform(heads, filled), ""), rest)).otherwise(F.col("text"))
    kept = [F.col(f"row.{_quoted(c)}").alias(c) for c in docs.columns]
    return rows.select(*[new.alias(text) if c == text else k for c, k in zip(docs.columns, kept)])


def span_digest(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """Spans of some kinds as ``kind:start:end``, joined by commas."""
    chosen = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def score_digest(spans: Column) -> Column:
    """Scores of the spans in hundredths, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.round(s["score"] * 100).cast("int").cast("string")), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
