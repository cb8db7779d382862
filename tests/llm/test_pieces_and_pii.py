import hashlib
import random
import re

import public_tokenizers
import pytest
import sentencepiece
from llm_cases import no_docs, odd_docs, plan_of  # noqa: F401 - fixtures
from pyspark.sql import functions as F

from hooktrace.llm import blocks, pieces, pii

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_packed_strings_round_trip():
    for items in ([], [""], ["a", "", "é\x00", "▁x" * 500]):
        assert blocks.unpack_strings(blocks.pack_strings(items)) == items


@pytest.mark.parametrize("size", [50, 10_000_000])
def test_encode_equals_the_library(odd_docs, size):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = pieces.encode(odd_docs, MODEL, keys=("doc_id", "packed"), block_bytes=size).collect()
    want = [(r.doc_id, r.packed, model.encode(r.text or "")) for r in odd_docs.collect()]
    assert sorted(map(repr, [(r.doc_id, r.packed, list(r.ids), r.decoded) for r in got])) == sorted(
        map(repr, [(a, b, c, model.decode(c)) for a, b, c in want])
    )


ODD_TEXTS = [
    " ", "   ", "a", " a", "  a", "a ", "a  ", "a  b", "▁", "▁▁a", "a▁b c", "a ▁ b", "one", "é\u0301 ǆ ﬁ x\u00a0y", "\n", " \n", "a\n b",
    "😀", "😀 a", "a 😀", " 😀", "\u4e00\u9fa5 \U0001f9ff\u200d", "a\x00b", "<s> </s> <unk>", "x" * 500, "the of and " * 50,
]


def test_odd_texts_equal_the_library(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = spark.createDataFrame(list(enumerate(ODD_TEXTS)), "doc_id long, text string")
    got = {r.doc_id: (list(r.ids), r.decoded) for r in pieces.encode(docs, MODEL).collect()}
    assert got == {i: (model.encode(t), model.decode(model.encode(t))) for i, t in enumerate(ODD_TEXTS)}


def test_words_join_to_the_marked_text():
    for text in [*ODD_TEXTS, "a b c", "a  b▁c "]:
        assert "".join("▁" + w for w in pieces.words(text)) == "▁" + text.replace(" ", "▁")
    assert pieces.words("") == []


def test_encode_nothing(no_docs):
    assert pieces.encode(no_docs, MODEL).collect() == []
    with pytest.raises(ValueError):
        pieces.encode(no_docs.withColumn("ids", F.lit(1)), MODEL, keys=("ids",))


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text: str) -> list[tuple]:
    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    def good(kind, m):
        digits = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            return 16 <= len(digits) <= 19 and luhn(digits)
        return kind == "email" or 8 <= len(digits) <= 15

    return [(k, m.start(), m.end()) for k in PLAIN for m in re.finditer(PLAIN[k], text) if good(k, m[0])]


TEXTS = [
    "mail a.b@c.d@e.f.+x@y.z, again x@y and @a.b q@1.2.3.4",
    "é😀 1.2.3.4.5.6.7.8 at 999.1.1.1 and 001.002.003.0255 host 10.0.0.1",
    "card 4111 1111 1111 1111, bad 4111-1111-1111-1112, 12345678901234567890123 5",
    "call +49 (30) 1234-5678 or +1 or +1 2 or +12345678901234567 +1((((",
    "IBAN DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432 but DE00 3704 0044 0532 0130 00",
    " ".join(f"u{i}@x.org 10.0.{i % 300}.1 +49 30 {i:08d}" for i in range(700)),
    "1" * 5_000 + " " + "a" * 5_000 + "@" + ".b" * 3_000,
    "", None,
]


def test_spans_equal_plain_search(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    rows = pii.find_pii(docs, text="t").orderBy("i").collect()
    for row, text in zip(rows, TEXTS):
        base = [(s.kind, s.start, s.end) for s in row.pii if s.kind in pii.BASE_KINDS]
        assert base == brute(text or ""), text and text[:80]
        assert all(0 < s.score <= 1 for s in row.pii)
    ibans = [TEXTS[4][s.start : s.end] for s in rows[4].pii if s.kind == "iban"]
    assert ibans == ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"]


def test_cards_without_adjacent_digits(spark):
    cards = [" ".join("4111111111111111"), "-".join("4111111111111111"), "a 4-1 1-1 1-1 1-1 1-1 1-1 1-1 1-1 b", "4 1 1", "4.1.1"]
    docs = spark.createDataFrame(list(enumerate(cards)), "i int, text string")
    rows = pii.find_pii(docs).orderBy("i").collect()
    assert [[(s.kind, s.start, s.end) for s in r.pii] for r in rows] == [brute(t) for t in cards]
    assert [len(r.pii) for r in rows] == [1, 1, 1, 0, 0]
    assert [r.text for r in pii.mask_pii(docs).orderBy("i").collect()] == ["[CARD]", "[CARD]", "a [CARD] b", "4 1 1", "4.1.1"]


def brute_added(text):
    """The added kinds of one text by plain loops, scores left out."""
    letters = "TRWAGMYFPDXBNJZSQVHLCKE"

    def good(kind, m, near):
        has = lambda words: any(w in near for w in words.split("|"))
        if kind == "dni":
            return letters[int(m[:8]) % 23] == m[-1]
        if kind == "ssn":
            a, b, c = m.split("-")
            return a not in ("000", "666") and a[0] != "9" and b != "00" and c != "0000" and has("ssn|social|security|taxpayer")
        if kind == "routing":
            first = int(m[:2])
            total = sum(int(c) * w for c, w in zip(m, (3, 7, 1) * 3))
            allowed = first <= 12 or 21 <= first <= 32 or 61 <= first <= 72 or first == 80
            return allowed and total % 10 == 0 and has("routing|aba|bank|transfer|wire")
        value = re.search("[A-Za-z0-9+/_.~-]{16,}={0,2}$", m)[0]
        return any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and len(set(value)) >= 8

    edge = lambda body: rf"(?a:\b){body}(?a:\b)"
    forms = {
        "dni": edge("[0-9]{8}-?[A-Z]"), "ssn": edge("[0-9]{3}-[0-9]{2}-[0-9]{4}"), "routing": edge("[0-9]{9}"),
        "secret": r"""(?i:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key)["']? {0,3}[:=] {0,3}["']?[A-Za-z0-9+/_.~-]{16,}={0,2}""",
    }
    found = []
    for kind, form in forms.items():
        hits = list(re.finditer(form, text))
        for i, m in enumerate(hits):
            left = text[hits[i - 1].end() if i else 0 : m.start()][-40:]
            right = text[m.end() : hits[i + 1].start() if i + 1 < len(hits) else len(text)][:40]
            if good(kind, m[0], f"{left} {right}".lower()):
                found.append((kind, m.start(), m.end()))
    return found


def test_added_kinds_equal_plain_search(spark):
    rng = random.Random(11)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    texts = [
        "DNI 12345678Z, 12345678-Z; not 12345678A or x12345678Z or 12345678Z9", "é SSN 123-45-6789 and 123-45-6789",
        "order 123-45-6789 went out", "social 000-12-3456 666-12-3456 900-12-3456 123-00-4567 123-45-0000",
        "routing 021000021, bank 021000022", "number 021000021 of ten", "wire 500000005", "ABA 011401533 é",
        'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x', "API_KEY: abcdefghijklmnop1", "password = aaaaaaaaaaaaaaaa1",
        "secret: abcdefghijklmnopqrst", "my_password='Zm9vYmFyMTIzNDU2Nzg5MA=='", "token is 04dbebab91ab85687d33eeaaf9ac", "key = 1234567890abcdefgh",
        "token=" + "a1b2c3d4e5" * 5_000, "token token: " * 3_000, "", None,
    ]
    texts += [f"bank {digits(9)} dni {digits(8)}{rng.choice('TRWAGMYF')} ssn {digits(3)}-{digits(2)}-{digits(4)}" for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    rows = pii.find_pii(docs).orderBy("i").collect()
    got = [[(s.kind, s.start, s.end) for s in r.pii if s.kind in ("dni", "ssn", "routing", "secret")] for r in rows]
    assert got == [brute_added(t or "") for t in texts]
    assert {s.kind for r in rows for s in r.pii} >= {"dni", "ssn", "routing", "secret"}
    assert all(s.score >= pii.KEEP_SCORE for r in rows for s in r.pii)
    masked = [r.text for r in pii.mask_pii(docs.where("i IN (1, 2, 8)")).orderBy("i").collect()]
    assert masked == ["é SSN [SSN] and 123-45-6789", "order 123-45-6789 went out", '[SECRET]" x']


def test_context_moves_the_score(spark):
    docs = spark.createDataFrame([("phone: +49 30 12345678",), ("x +49 30 12345678",)], "text string")
    near, far = [r.pii[0].score for r in pii.find_pii(docs).collect()]
    assert near > far


def test_masks_valid_spans_only(spark):
    docs = spark.createDataFrame([("é a@b.c, 10.0.0.1 999.1.1.1 +49 30 12345678, 4111 1111 1111 1111",), (None,), ("",)], "text string")
    got = [r.text for r in pii.mask_pii(docs).collect()]
    assert got == ["é [EMAIL], [IP] 999.1.1.1 [PHONE], [CARD]", None, ""]


def merged_mask(text, spans):
    out, at, group = "", 0, []
    for s in [*sorted(spans, key=lambda s: s.start), None]:
        if group and (s is None or s.start >= max(g.end for g in group)):
            widest = max(group, key=lambda g: (g.end - g.start, g.kind))
            out += text[at : group[0].start] + f"[{widest.kind.upper()}]"
            at, group = max(g.end for g in group), []
        group.append(s)
    return out + text[at:]


def test_masks_what_is_found(spark):
    """Overlapping ip and phone, iban and card, e-mail and ip go as one; long texts, many spans."""
    overlapping = [
        "ring +33.1.42.68.53.00 now",
        "card 4111 1111 1111 1111 in GB70 4111 1111 1111 1111 ok",
        "me@10.0.0.1 and 10.0.0.1@x.org",
        "+49 30 12345678",
        " ".join(f"é{i} +33.1.42.68.53.{i % 90 + 10} u{i}@x.org" for i in range(300)),
    ]
    texts = [t for t in TEXTS if t] + overlapping
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    found = [r.pii for r in pii.find_pii(docs).orderBy("i").collect()]
    got = [r.text for r in pii.mask_pii(docs).orderBy("i").collect()]
    assert got == [merged_mask(t, s) for t, s in zip(texts, found)]
    assert got[len(texts) - 5] == "ring [PHONE] now" and "4111" not in got[len(texts) - 4]


def test_odd_input_and_no_python(odd_docs, no_docs):
    found = pii.find_pii(odd_docs)
    assert found.count() == odd_docs.count() and set(found.columns) == set(odd_docs.columns)
    assert pii.find_pii(no_docs).collect() == [] and pii.mask_pii(no_docs).collect() == []
    assert pii.mask_pii(odd_docs).columns == odd_docs.columns
    plan = plan_of(found)
    assert "Python" not in plan[plan.index("== Physical Plan") :] and "Exchange" not in plan[plan.index("== Physical Plan") :]


def test_digest_text(spark):
    rows = pii.find_pii(spark.createDataFrame([("a@b.c 10.0.0.1",)], "text string"))
    text = rows.select(pii.span_digest(F.col("pii"))).first()[0]
    assert text == "email:0:5,ip:6:14"
    assert hashlib.sha256(text.encode()).hexdigest() == rows.select(F.sha2(pii.span_digest(F.col("pii")), 256)).first()[0]
