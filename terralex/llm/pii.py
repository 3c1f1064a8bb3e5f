"""Personal data by weak-supervision aggregation.

Base spans (email, ip, card, phone) follow fixed patterns and checks, and always stay. Looser
patterns propose more candidates: written-out addresses, national numbers, keys and passwords, bare
numbers, and matches of a base pattern that fail its check. On each candidate seven labelers vote for,
against or not at all: strict form, checksum or range, a gazetteer, words before it that announce its
kind or another, its limits, its variety. The votes of all
documents are counted by pattern (a table bounded by the labelers, not by the corpus);
expectation-maximisation estimates each labeler's reliability from these counts, base spans included,
and a logistic span classifier is trained on the posteriors. Candidates that it accepts are added.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralex.llm.common import Scratch, released, slices

#: Kinds in the order in which spans of one start are listed.
BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, "ssn", "iban", "secret"]

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: The same where a run of characters begins: entering every run at each of its characters would take a square of its length.
EMAIL_RUN = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Candidates beyond the base spans, by kind; those of a kind with a base pattern that fail its check come besides.
LOOSE = {
    "email": re.compile(r"\b[A-Za-z0-9._%+-]{1,64} ?(?:\[at\]|\(at\)| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\[dot\]|\(dot\)| dot ) ?[A-Za-z0-9-]{1,63}){1,4}\b"),
    "ssn": re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?!\w)"),
    "assigned": re.compile(r"(?i)(?<![a-z0-9])(?:password|passwd|pwd|secret|api[_-]?key|access[_-]?key|auth[_-]?token)[\"']? ?[=:] ?[\"']?([^\s\"']{6,128})"),
    "secret": re.compile(r"(?<![\w-])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|(?=[A-Za-z_-]*[0-9])(?=[0-9_-]*[A-Za-z])[A-Za-z0-9_-]{16,128})(?![\w-])"),
    "phone": re.compile(r"(?<![\w.+-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![\w-])"),
    "card": re.compile(r"(?<![\w.+-])[0-9]{7,24}(?![\w-])"),
}
#: Beginnings of keys that services hand out.
KEYS = ("AKIA", "ASIA", "ghp_", "gho_", "sk-", "pk_", "sk_", "xoxb-", "xoxp-", "AIza", "glpat-")
#: Gazetteer: top-level domains, and words that announce a kind.
DOMAINS = {"com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "it", "nl", "uk", "eu", "ch", "at"}
CUES = {
    "email": {"mail", "email", "e-mail", "contact", "write", "correo", "courriel", "kontakt"},
    "phone": {"phone", "tel", "telephone", "call", "mobile", "cell", "fax", "telefon", "teléfono", "téléphone", "mobil", "anrufen"},
    "ip": {"ip", "host", "server", "address", "login", "from"},
    "card": {"card", "visa", "credit", "debit", "mastercard", "amex", "karte", "carte", "tarjeta"},
    "ssn": {"ssn", "social", "security"},
    "iban": {"iban", "account", "bank", "konto", "compte", "cuenta"},
    "secret": {"password", "passwd", "pwd", "secret", "key", "token", "credential", "credentials"},
}
AGAINST = {"version", "page", "section", "chapter", "isbn", "issn", "doi", "id", "no", "nr", "order", "invoice"}
ABOUT = re.compile(r"[\w-]+")
CARD_FORM = re.compile(r"[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{2,4}|[0-9]{4}([ -]?)[0-9]{6}\2[0-9]{5}|[0-9]{13,19}")
#: Characters before a span that the context labelers read.
CONTEXT = 40
#: A span's probability from which it is added.
ACCEPT = 0.5
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[Span]:
    """Leftmost non-overlapping matches of EMAIL: a match may begin inside a run only where the one before ended."""
    at = 0
    while m := (EMAIL.match(text, at) if at else None) or EMAIL_RUN.search(text, at):
        yield "email", *m.span()
        at = m.end()


def checked(text: str) -> tuple[list[Span], list[Span]]:
    """Leftmost non-overlapping matches of each base kind: those that pass its check, and those that fail it."""
    good: list[Span] = []
    bad: list[Span] = []
    if "@" in text:
        good += emails(text)
    if re.search("[0-9]", text):
        for m in IP.finditer(text):
            ok = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))
            (good if ok else bad).append(("ip", *m.span()))
        for m in CARD.finditer(text):
            d = digits_of(m.group())
            if 14 <= len(d) <= 19 and luhn(d):
                good.append(("card", *m.span()))
            elif 12 <= len(d) <= 19:
                bad.append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                (good if 10 <= len(digits_of(m.group())) <= 15 else bad).append(("phone", *m.span()))
    return in_order(good), in_order(bad)


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its check."""
    return checked(text)[0]


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


class Taken:
    """Disjoint ranges in order; overlapping ones that are put in are merged."""

    def __init__(self, ranges: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(ranges):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def add(self, a: int, b: int) -> bool:
        """Takes a range if nothing of it is taken yet."""
        i = bisect_left(self.starts, b)
        if i and self.ends[i - 1] > a:
            return False
        self.starts.insert(i, a)
        self.ends.insert(i, b)
        return True


def proposed(text: str, base: list[Span], failed: list[Span]) -> list[Span]:
    """Candidates that touch neither a base span nor an earlier candidate: loose forms by kind, then matches that failed their check."""
    kinds = []
    if "[at]" in text or "(at)" in text or " dot " in text or "(dot)" in text or "[dot]" in text:
        kinds.append("email")
    if re.search("[0-9]{3}", text):
        kinds += ["ssn", "iban"]
    if "=" in text or ":" in text:
        kinds.append("assigned")
    if re.search("AKIA|ASIA|[0-9]", text):
        kinds += ["secret", "phone", "card"]
    out: list[Span] = []
    taken = Taken([(a, b) for _, a, b in base])
    for kind in kinds:
        for m in LOOSE[kind].finditer(text):
            a, b = m.span(1) if kind == "assigned" else m.span()
            if taken.add(a, b):
                out.append(("secret" if kind == "assigned" else kind, a, b))
    out += [s for s in failed if taken.add(s[1], s[2])]
    return out


def votes(text: str, span: Span) -> str:
    """A character for each labeler: + for, - against, 0 for none; the kind's number in front."""
    kind, a, b = span
    found = text[a:b]
    digits = digits_of(found)
    before = {w.lower() for w in ABOUT.findall(text[max(0, a - CONTEXT) : a])[-5:]}
    alone = (a == 0 or not text[a - 1].isalnum()) and (b == len(text) or not text[b].isalnum())
    given = text[max(0, a - 3) : a].rstrip("\"' ")[-1:]
    strict = {
        "email": "@" in found or "[at]" in found or "(at)" in found,
        "ip": all(p == str(int(p)) for p in found.split(".") if len(p) < 9) if kind == "ip" else False,
        "card": bool(CARD_FORM.fullmatch(found)),
        "phone": found.startswith("+") or found.startswith("("),
        "ssn": True,
        "iban": True,
        "secret": found.startswith(KEYS) or given in ("=", ":"),
    }[kind]
    valid = {
        "email": True,
        "ip": all(len(p) < 9 and int(p) <= 255 for p in found.split(".")) if kind == "ip" else False,
        "card": 13 <= len(digits) <= 19 and luhn(digits),
        "phone": 10 <= len(digits) <= 15,
        "ssn": digits[:3] not in ("000", "666") and digits[:1] != "9" and digits[3:5] != "00" and digits[5:] != "0000",
        "iban": kind == "iban" and iban(found),
        "secret": found.startswith(KEYS) or bool(digits) and len(digits) < len(found) and len(set(found)) >= 8,
    }[kind]
    listed = {
        "email": found.replace("]", " ").replace(")", " ").replace(".", " ").split()[-1].lower() in DOMAINS if kind == "email" else False,
        "card": digits[:1] in ("3", "4", "5", "6"),
        "phone": found.startswith("+1") or digits[-7:-4] == "555",
        "iban": found[:2] in ("DE", "FR", "ES", "IT", "NL", "GB", "AT", "CH", "BE"),
        "secret": found.startswith(KEYS),
    }.get(kind)
    cue = bool(before & CUES[kind])
    return str(KINDS.index(kind)) + "".join([
        "+" if strict else "-",
        "+" if valid else "-",
        "0" if listed is None else "+" if listed else "0" if kind == "secret" else "-",
        "+" if cue else "0",
        "-" if before & AGAINST or before & set().union(*(CUES[k] for k in KINDS if k != kind)) and not cue else "0",
        "+" if alone else "-",
        "-" if len(set(digits)) < 4 and kind not in ("email", "ip", "secret") else "0",
    ])


def iban(found: str) -> bool:
    s = found.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def fit(counts: dict[str, int], base: dict[str, int], rounds: int = 60) -> dict[str, float]:
    """Probability of each vote pattern to be personal data.

    counts: candidates by pattern; base: base spans by pattern, which are taken as personal data.
    A labeler that gives no vote says nothing.
    """
    patterns = sorted({*counts, *base})
    if not patterns:
        return {}
    cast = np.array([[[c == "+", c == "-"] for c in p[1:]] for p in patterns], float)
    open_, known = (np.array([c.get(p, 0) for p in patterns], float) for c in (counts, base))
    # reliabilities: probability of each labeler's vote, if it votes, where it is (1) and isn't (0) personal data
    post = 1 / (1 + np.exp(cast[..., 1].sum(axis=1) - cast[..., 0].sum(axis=1) + 0.5))
    for _ in range(rounds):
        yes, no = known + open_ * post, open_ * (1 - post)
        prior = (open_ @ post + 1) / (open_.sum() + 2)
        trust = np.array([0.8, 0.2]), np.array([0.2, 0.8])  # a labeler that hardly votes keeps these
        sums = [np.einsum("n,nlv->lv", w, cast) + 4 * t for w, t in zip((yes, no), trust, strict=True)]
        p1, p0 = (x / x.sum(axis=1, keepdims=True) for x in sums)
        z = (cast * np.log(p1 / p0)).sum(axis=(1, 2)) + np.log(prior / (1 - prior))
        post = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    # the final span classifier: logistic, on votes and kind
    kinds = np.eye(len(KINDS))[[int(p[0]) for p in patterns]]
    x = np.hstack([cast.reshape(len(patterns), -1), kinds, np.ones((len(patterns), 1))])
    weight = known + open_
    target = (known + open_ * post) / np.maximum(weight, 1e-9)
    weight = np.log1p(weight)
    w = np.zeros(x.shape[1])
    for _ in range(800):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= 0.5 * (x.T @ (weight * (p - target)) / weight.sum() + 1e-3 * w)
    return dict(zip(patterns, (1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))).tolist(), strict=True))


SPANS = "array<struct<kind: string, a: int, b: int, votes: string, base: boolean>>"


def _candidates(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("votes", pa.string()), ("base", pa.bool_())]))
        for batch in slices(batches):
            out = []
            for text in batch.column("text").to_pylist():
                text = text or ""
                base, failed = checked(text)
                more = proposed(text, base, failed)
                out.append([{"kind": s[0], "a": s[1], "b": s[2], "votes": votes(text, s), "base": i < len(base)} for i, s in enumerate([*base, *more])])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, kind)], [*names, "found"])

    return released(run)


def _accepted(found: list[dict], of: dict[str, float]) -> list[Span]:
    return in_order([(s["kind"], s["a"], s["b"]) for s in found if s["base"] or of.get(s["votes"], 0.0) >= ACCEPT])


def _probabilities(found: DataFrame) -> dict[str, float]:
    """Counts votes over all documents, by pattern, and fits the classifier to them."""
    spans = found.select(F.explode("found").alias("s")).groupBy("s.votes", "s.base").count()
    rows = spans.collect()  # at most kinds * 3^7 * 2 rows
    return fit({r["votes"]: r["count"] for r in rows if not r["base"]}, {r["votes"]: r["count"] for r in rows if r["base"]})


def pii_spans(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text string): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    The counts and base_sha256 are of base spans (kind:start:end by start, then kind, joined by commas;
    code points, end exclusive); spans lists all, written alike. Text: a null one counts as empty. Other
    columns are ignored, repeated rows stay, and an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    found = scratch.cut(rows.mapInArrow(_candidates(["doc_id"]), f"doc_id {kind}, found {SPANS}"))
    of = _probabilities(found)

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for spans in batch.column("found").to_pylist():
                base = in_order([(s["kind"], s["a"], s["b"]) for s in spans if s["base"]])
                row = [*(sum(s[0] == k for s in base) for k in BASE_KINDS), sha256(written(base).encode()).hexdigest(), written(_accepted(spans, of))]
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return found.mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping ones the first."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
            at = b
        elif b > at:  # the rest of a span that overlaps the one before
            at = b
    return "".join([*out, text[at:]])


def mask_pii(docs: DataFrame) -> DataFrame:
    """Rows and columns of docs, with the personal data in column text masked.

    Null and empty texts stay as they are, rows that repeat stay, other columns of whatever names are
    handed through, an empty table stays empty, and texts of any length take a time in proportion.
    """
    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_candidates([]), f"found {SPANS}")
    of = _probabilities(found)
    names = docs.columns

    def run(batches):
        for batch in slices(batches):
            texts = []
            for text in batch.column("text").to_pylist():
                if text:
                    base, failed = checked(text)
                    more = [s for s in proposed(text, base, failed) if of.get(votes(text, s), 0.0) >= ACCEPT]
                    if base or more:
                        text = masked(text, in_order([*base, *more]))
                texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names], names)

    return docs.mapInArrow(released(run), docs.schema)
