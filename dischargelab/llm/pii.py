"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, schemes (``://``) and
words that announce an identifier. A local parser expands each anchor to both sides as far as its kind
allows, validates what it found and hands on (kind, start, end) in code points, end exclusive.

Base kinds: email, ip, card, phone. The method adds url (an address with a scheme and a host) and
account (an identifier after a word that announces one, bank accounts by their check digits).

Per kind, matches are leftmost and don't overlap; a failed match is dropped and not tried again from a
later start. Texts are scanned whole.

Defined cases: a null or empty text has no spans; rows are independent, so null or repeated doc_ids pass
through; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dischargelab.llm.common import map_batches, slim, table

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
# Words that announce an identifier; each also in capitals and with a capital first letter.
CUES = ("account", "acct", "iban", "konto", "kontonummer", "compte", "cuenta", "ssn", "passport", "token", "api_key", "apikey",
        "password", "secret")

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
GROUPED = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
HOST = re.compile(r"://(?:[A-Za-z0-9._~%!$&'()*+,;=:-]+@)?(?:[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*)(?::[0-9]+)?(?:[/?#][^\s\"<>]*)?")
# Behind a cue: groups of four, which check digits must confirm, or a whole run of characters of tokens and keys.
GAP = r"(?:[ _-]?(?:number|no|nr|id))?[ .:=#\"']{1,6}"
GROUPS_AFTER_CUE = re.compile(GAP + r"([A-Z]{2}[0-9]{2}(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
IN_RUN = r"(?:[A-Za-z0-9_/+=-]|\.(?=[A-Za-z0-9_-]))"
AFTER_CUE = re.compile(GAP + rf"(?=[A-Za-z0-9]{IN_RUN}{{5}})")
RUN = re.compile(f"{IN_RUN}+")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}")
DIGITS = re.compile(r"[0-9]")


@functools.lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for d in "0123456789":
        a.add_word(d, ("digit", 1))
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    a.add_word("://", ("scheme", 3))
    for cue in CUES:
        for form in (cue, cue.upper(), cue.capitalize()):
            a.add_word(form, ("cue", len(form)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def octet(part: str) -> bool:
    value = part.lstrip("0")
    return len(value) <= 3 and (not value or int(value) <= 255)


def addresses(text: str, start: int) -> tuple[list[tuple[int, int]], int]:
    """IPs in the dotted run at ``start``, four parts at a time; and where the run ends."""
    run = DOTTED.match(text, start)
    parts, found, at = run[0].split("."), [], start
    for i in range(0, len(parts) - 3, 4):
        four = parts[i: i + 4]
        end = at + sum(map(len, four)) + 3
        if all(map(octet, four)):
            found.append((at, end))
        at = end + 1
    return found, run.end()


def checked(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def account(text: str, at: int, tried: int) -> tuple[tuple[int, int] | None, int]:
    """The identifier after a cue that ends at ``at``: digits in it, and check digits if it looks like an IBAN. Words in
    capitals may follow an IBAN in groups: the most groups that the check digits confirm are taken.

    A run of characters is read once, whatever cues lie in it: ``tried`` is the end of the last one, and the second result
    its new value. A run without enough digits has no part with enough, and one that is taken leaves no part.
    """
    if m := GROUPS_AFTER_CUE.match(text, at):
        groups = m[1].split(" ")
        for n in range(len(groups), 2, -1):
            whole = "".join(groups[:n])
            if m.start(1) >= tried and IBAN.fullmatch(whole) and checked(whole):
                end = m.start(1) + len(" ".join(groups[:n]))
                return (m.start(1), end), end
    m = AFTER_CUE.match(text, at)
    if m is None or m.end() < tried:
        return None, tried
    run = RUN.match(text, m.end())
    if run.end() - run.start() <= 34 and IBAN.fullmatch(run[0]) and not checked(run[0]):
        return None, tried
    return (run.span() if len(DIGITS.findall(run[0])) >= 4 else None), run.end()


def find(text: str) -> list[tuple[str, int, int]]:
    """All spans, by start and then by kind as listed in ``KINDS``."""
    spans: list[tuple[str, int, int]] = []
    email_end = ip_end = card_end = url_end = account_end = 0
    for last, (anchor, width) in automaton().iter(text):
        at = last - width + 1
        if anchor == "digit":
            if at >= ip_end:
                found, ip_end = addresses(text, at)
                spans += [("ip", s, e) for s, e in found]
            if at >= card_end and (m := GROUPED.match(text, at)):
                card_end = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    spans.append(("card", at, card_end))
        elif anchor == "at":
            start = at
            while start > email_end and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at)):
                email_end = m.end()
                spans.append(("email", start, email_end))
        elif anchor == "plus":
            if (m := PHONE.match(text, at)) and 10 <= len(DIGITS.findall(m[0])) <= 15:
                spans.append(("phone", at, m.end()))
        elif anchor == "scheme":
            start = at
            while start > url_end and text[start - 1] in SCHEME:
                start -= 1
            if start < at and text[start].isalpha() and (m := HOST.match(text, at)):
                url_end = m.end()
                spans.append(("url", start, url_end))
        else:
            span, account_end = account(text, last + 1, account_end)
            spans += [("account", *span)] if span else []
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind; of overlapping spans the first gives the kind."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<kind,start,end>>) of every row."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in find(t)] if t else [] for t in batch.column("text").to_pylist()]
        return pa.record_batch({"doc_id": batch.column("doc_id"), "spans": pa.array(found, SPAN)})

    return map_batches(slim(docs, id_col, text_col), kernel, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def mask_pii(docs: DataFrame, text_col: str = "text", kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """The same rows and columns, with every span of ``kinds`` in the text replaced by its kind."""
    place = docs.columns.index(text_col)
    schema = docs.schema

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        masked = [t and mask(t, [s for s in find(t) if s[0] in kinds]) for t in batch.column(place).to_pylist()]
        return batch.set_column(place, batch.schema.field(place), pa.array(masked, batch.schema.field(place).type))

    return map_batches(docs, kernel, schema, place)


def op10(spark, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    listed = "array_join(transform({}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    base = F.expr(listed.format(f"filter(spans, s -> s.kind IN {BASE_KINDS})"))
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) AS long)").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), F.expr(listed.format("spans")).alias("spans"))
