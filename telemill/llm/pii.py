"""Personal data: patterns propose spans, checksums confirm, context words adjust the score.

Defined results: a null or empty text has no spans; offsets are code points with
exclusive ends; rows are independent, so repeated rows give repeated results and
an empty table an empty one. All scans are linear in the text: runs are matched
possessively or entered from their anchor, never retried from each of their
characters, so that one very long run costs no more than as many short ones.
"""

from __future__ import annotations

import re
from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Kinds in the order in which spans are listed; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "phone_local", "secret", "birth_date")
MIN_SCORE = 0.6
CONTEXT_CHARS = 48

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NON_DIGIT = re.compile(r"[^0-9]")
_ANY_DIGIT = re.compile(r"[0-9]")

#: (kind, pattern, base score, words that raise the score when near). Context adds 0.35. A group named v is the span, else all of the match.
_PROPOSALS = (
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), 0.9, ("iban", "account", "konto", "compte", "cuenta", "bank")),
    ("ssn", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"), 0.45, ("ssn", "social security", "sozialversicherung", "sécurité sociale", "seguridad social")),
    ("phone_local", re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])"), 0.35, ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono")),
    ("secret", re.compile(r"(?<![A-Za-z0-9])(?:[0-9a-f]{40}|[0-9A-F]{40})(?![A-Za-z0-9])"), 0.35, ("token", "key", "secret", "password", "api")),
    # public formats of access keys, tokens and private keys
    ("secret", re.compile(r"(?<![A-Za-z0-9_-])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,72}|eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+)(?![A-Za-z0-9_-])|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"), 0.9, ()),
    ("secret", re.compile(r"(?i)(?<![a-z0-9])(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)[\"']?[ \t]{0,3}[=:][ \t]{0,3}[\"']?(?P<v>(?=[^\s\"',;]{0,63}[0-9])(?=[^\s\"',;]{0,63}[a-z])[^\s\"',;]{12,64})(?![^\s\"',;])"), 0.65, ()),
    ("birth_date", re.compile(r"(?<![0-9-])(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9](?![0-9-])"), 0.3, ("born", "birth", "dob", "geboren", "né le", "nacido", "nacimiento")),
)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _emails(text: str) -> list[tuple[int, int]]:
    found, done = [], 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > done and _LOCAL.match(text, begin - 1):
            begin -= 1
        m = _DOMAIN.match(text, at) if begin < at else None
        if m:
            found.append((begin, m.end()))
            done = m.end()
            at = text.find("@", done)
        else:
            # no later match can begin before this sign: it is in neither part of an address's local name
            done = at + 1
            at = text.find("@", at + 1)
    return found


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS[:4]}
    if "@" in text:
        out["email"] = _emails(text)
    if not _ANY_DIGIT.search(text):
        return out
    if "." in text:
        out["ip"] = [m.span() for m in _IP.finditer(text) if all(map(_octet, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NON_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
    if "+" in text:
        out["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_NON_DIGIT.sub("", m[0])) <= 15]
    return out


def _iban_end(found: str) -> int:
    """Where the longest run of its groups ends that is of a fit length and passes mod 97; 0 for none. A word in capitals may follow an account."""
    end = len(found)
    while end > 0:
        plain = found[:end].replace(" ", "")
        if 15 <= len(plain) <= 34 and mod97(plain):
            return end
        end = found.rfind(" ", 0, end)
    return 0


class _Taken:
    """Spans that were given out, apart from each other."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts, self.ends = [], []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        i = bisect_left(self.starts, b) - 1
        return i >= 0 and self.ends[i] > a


def method_spans(text: str, base: dict[str, list[tuple[int, int]]]) -> list[tuple[str, int, int, float]]:
    """Further kinds, scored: pattern, checksum where there is one, context near by. Base spans aren't covered again, nor a kind's own."""
    if not _ANY_DIGIT.search(text) and "PRIVATE KEY" not in text:
        return []
    taken = _Taken([s for spans in base.values() for s in spans])
    found: dict[str, list[tuple[str, int, int, float]]] = {k: [] for k in KINDS[4:]}
    for kind, pattern, score, near in _PROPOSALS:
        own = _Taken([s[1:3] for s in found[kind]])
        at = 0
        while m := pattern.search(text, at):
            a, b = m.span("v" if "v" in pattern.groupindex else 0)
            at = m.end()
            if kind == "iban":
                end = _iban_end(m[0])
                # after a failure the next may begin at the next word of this one
                at = a + end if end else m.start() + (m[0].find(" ") + 1 or len(m[0]))
                b = a + end
            if a == b or taken.meets(a, b) or own.meets(a, b):
                continue
            around = text[max(0, a - CONTEXT_CHARS) : b + CONTEXT_CHARS].lower()
            got = score + (0.35 if any(w in around for w in near) else 0.0)
            if got >= MIN_SCORE:
                found[kind].append((kind, a, b, round(min(got, 1.0), 2)))
    return [x for kind in KINDS[4:] for x in found[kind]]


def scan(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int, float]]]:
    text = text or ""
    base = base_spans(text)
    return [(k, a, b) for k in KINDS[:4] for a, b in base[k]], method_spans(text, base)


def detect_pii(docs: DataFrame) -> DataFrame:
    """doc_id, spans: every personal-data span of every whole text, with kind, offsets and score."""

    def batch(cols: dict[str, list]) -> dict[str, list]:
        spans = []
        for text in cols["text"]:
            base, more = scan(text)
            rows = [(k, a, b, 1.0, True) for k, a, b in base] + [(k, a, b, s, False) for k, a, b, s in more]
            spans.append([dict(zip(("kind", "start", "end", "score", "base"), r, strict=True)) for r in rows])
        return {"doc_id": cols["doc_id"], "spans": spans}

    return common.map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), batch, "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double,base:boolean>>")


def redact(text: str | None, spans) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping spans merge under the first kind."""
    if text is None:
        return None
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= at:
            out += [text[at : s["start"]], f"[{s['kind']}]"]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect_pii(common.table(spark, sf_dir, "documents"))
    order = F.array(*map(F.lit, KINDS))
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(F.array_position(order, s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["base"].alias("base"), s["score"].alias("score"))))
    told = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda kind: F.size(F.filter("o", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", ordered.alias("o")).select(
        "doc_id", *(count(k) for k in KINDS[:4]), F.sha2(told(F.filter("o", lambda s: s["base"])), 256).alias("base_sha256"), told("o").alias("spans"), F.size("o").cast("long").alias("n_spans"),
        F.concat_ws(",", F.transform("o", lambda s: F.format_number(s["score"], 2))).alias("scores"),
    )
