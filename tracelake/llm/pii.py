"""Personal data by anchor expansion: an Aho-Corasick automaton finds at-signs, schemes, plus signs, digits and identifier
cues in one pass over a text; a deterministic parser expands each anchor to the left and right and validates what it got.

Beside the base kinds (email, ip, card, phone) it finds `url` (a scheme and what follows), `account` (a number behind an identifier
cue; an IBAN must pass its check) and `secret` (a key, token or password that is given behind = or :).  Spans of one kind never
overlap; spans of different kinds may, and are all listed; where text is masked, the union of such spans takes the first one's name.

Rows: a null text counts as empty and has no spans; repeated rows are each scanned; an empty table gives no rows; any further
columns are ignored.
Offsets are code points, the end is exclusive.  A text takes time in proportion to its length, whatever it holds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import map_slices

KINDS = ("email", "ip", "card", "phone")
#: Kinds that the method adds to the four base kinds.
MORE = ("url", "account", "secret")
#: Cues in front of an account or identity number.
CUES = ("iban", "iban no", "iban number", "account no", "account number", "acct", "passport no", "passport number", "ssn", "tax id")
#: Names behind which a secret is given.
SECRETS = ("api key", "api_key", "api-key", "apikey", "access key", "access_key", "private key", "private_key", "secret", "secret key", "secret_key", "client_secret", "token", "auth_token", "access_token", "password", "passwd", "passphrase", "pwd", "bearer")
#: Characters of an IBAN by country.
IBAN = {x[:2]: int(x[2:]) for x in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 "
    "FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 "
    "ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 "
    "ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
).split()}

DIGITS = frozenset("0123456789")
WORD = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
LOCAL = WORD | frozenset("._%+-")
LABEL = WORD | frozenset("-")
PHONE = DIGITS | frozenset(" ().-")
SECRET = WORD | frozenset("_-+/=.~!@#$%^&*?")

_automaton = None


def automaton():
    """Anchors of every kind; built once in each Python worker."""
    global _automaton
    if _automaton is None:
        import ahocorasick

        a = ahocorasick.Automaton()
        for c in "0123456789":
            a.add_word(c, ("digit", 1))
        a.add_word("@", ("at", 1))
        a.add_word("+", ("plus", 1))
        a.add_word("://", ("scheme", 3))
        for cue in CUES:
            a.add_word(cue, ("cue", len(cue)))
        for cue in SECRETS:
            a.add_word(cue, ("bearer" if cue == "bearer" else "secret", len(cue)))
        a.make_automaton()
        _automaton = a
    return _automaton


def lowered(text: str) -> str:
    """A-Z in lower case, all else as it is, so that offsets stay."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def run_end(text: str, i: int, chars: frozenset) -> int:
    n = len(text)
    while i < n and text[i] in chars:
        i += 1
    return i


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def email_at(text: str, at: int, after: int) -> tuple[int, int] | None:
    """The address around the at-sign, its local part not reaching before `after`."""
    start = at
    while start > after and text[start - 1] in LOCAL:
        start -= 1
    if start == at:
        return None
    end = run_end(text, at + 1, LABEL)
    if end == at + 1:
        return None
    labels = 0
    while end + 1 < len(text) and text[end] == "." and text[end + 1] in LABEL:
        end = run_end(text, end + 1, LABEL)
        labels += 1
    return (start, end) if labels else None


def ip_at(text: str, start: int) -> tuple[int, int, bool] | None:
    """Four dotted numbers from a digit on; the flag tells whether each is at most 255."""
    ok, at = True, start
    for part in range(4):
        if part:
            if at + 1 >= len(text) or text[at] != "." or text[at + 1] not in DIGITS:
                return None
            at += 1
        end = run_end(text, at, DIGITS)
        ok = ok and len(text[at:end].lstrip("0")) <= 3 and int(text[at:end][-3:]) <= 255
        at = end
    return start, at, ok


def card_at(text: str, start: int) -> tuple[int, str]:
    """End and digits of the digits from start on, between which one blank or hyphen may stand."""
    at, n, out = start, len(text), []
    while True:
        end = run_end(text, at, DIGITS)
        out.append(text[at:end])
        if end + 1 < n and text[end] in " -" and text[end + 1] in DIGITS:
            at = end + 1
        else:
            return end, "".join(out)


def phone_at(text: str, plus: int) -> tuple[int, int] | None:
    if plus + 1 >= len(text) or text[plus + 1] not in DIGITS:
        return None
    end = run_end(text, plus + 2, PHONE)
    while end > plus + 3 and text[end - 1] not in DIGITS:
        end -= 1
    return (plus, end) if end >= plus + 4 and text[end - 1] in DIGITS else None


def iban_at(text: str, cue_end: int) -> tuple[int, int] | None:
    """After a cue: up to three signs, then an IBAN of its country's length that passes its check, with single blanks or hyphens."""
    at, n = cue_end, len(text)
    while at < n and at < cue_end + 3 and text[at] in " :#.":
        at += 1
    start, signs = at, []
    size = IBAN.get(text[at : at + 2].upper(), 0)
    while len(signs) < size:
        if at < n and signs and text[at] in " -":
            at += 1
        if at >= n or text[at] not in WORD:
            return None
        signs.append(text[at])
        at += 1
    if not size or at < n and text[at] in WORD:
        return None
    number = "".join(str(int(c, 36)) for c in signs[4:] + signs[:4])
    return (start, at) if int(number) % 97 == 1 else None


def account_at(text: str, cue_end: int) -> tuple[int, int] | None:
    """After a cue: up to three signs, then 6 to 34 letters, digits and single blanks or hyphens, of them 6 digits at least."""
    at = cue_end
    while at < len(text) and at < cue_end + 3 and text[at] in " :#.":
        at += 1
    start = at
    end = run_end(text, at, WORD)
    while end + 1 < len(text) and text[end] in " -" and text[end + 1] in DIGITS and end - start < 34:
        end = run_end(text, end + 1, WORD)
    body = text[start:end]
    return (start, end) if len(body) <= 42 and sum(c in DIGITS for c in body) >= 6 else None


class Run:
    """The last run of characters of one kind that was scanned, so that later anchors within it don't scan it again: its end, its end
    without the marks that close a sentence, and the last places of a digit and of a sign that stands in no number."""

    def __init__(self, inside: Callable[[str], bool], marks: str):
        self.inside, self.marks = inside, marks
        self.start = self.end = self.trimmed = 0
        self.digit = self.other = -1

    def at(self, text: str, start: int) -> "Run":
        if not self.start <= start < self.end:
            end, n = start, len(text)
            while end < n and self.inside(text[end]):
                end += 1
            self.start, self.end, self.digit, self.other = start, end, -1, -1
            while end > start and text[end - 1] in self.marks:
                end -= 1
            self.trimmed = end
            for i in range(end - 1, start - 1, -1):
                if text[i] in DIGITS:
                    self.digit = max(self.digit, i)
                elif text[i] not in "./-":
                    self.other = max(self.other, i)
                if self.digit >= 0 and self.other >= 0:
                    break
        return self


def secret_at(text: str, cue_end: int, run: Run, bearer: bool = False) -> tuple[int, int] | None:
    """After a name: = or :, with quotes and up to two blanks about it - or, after `bearer`, a blank - then 8 characters or more of
    which one is a digit and one no part of a number; between quotes 10 or more of any.  Sentence marks at the end stay out."""
    at, n = cue_end, len(text)
    if bearer and at + 1 < n and text[at] == " " and text[at + 1] in WORD:
        at += 1
    else:
        at += at < n and text[at] in "\"'"
        for wanted in (" ", " ", "=:", ">=", " ", " ", "\"'"):
            at += at < n and text[at] in wanted
            if wanted == "=:" and text[at - 1] not in "=:":
                return None
    r = run.at(text, at)
    quote = text[at - 1] if text[at - 1] in "\"'" else ""
    if quote and r.end < n and text[r.end] == quote and r.end - at >= 10:
        return at, r.end
    return (at, r.trimmed) if r.trimmed - at >= 8 and r.digit >= at and r.other >= at else None


def url_at(text: str, colon: int, after: int, run: Run) -> tuple[int, int] | None:
    start = colon
    while start > after and text[start - 1] in WORD:
        start -= 1
    if start == colon or colon + 3 >= len(text):
        return None
    end = run.at(text, colon + 3).trimmed
    return (start, end) if end > colon + 3 else None


def in_url(c: str) -> bool:
    return not c.isspace() and c not in "\"'<>()[]{}|"


def find_spans(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """Spans of every kind, in the order of their starts."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in (*KINDS, *MORE)}
    if not text:
        return out
    done = dict.fromkeys(out, 0)  # end of the last match of each kind, valid or not
    run = 0  # end of the digits that the last digit anchor began
    secrets, urls = Run(SECRET.__contains__, ".!?"), Run(in_url, ".,;:!?")
    for last, (what, size) in automaton().iter(lowered(text)):
        at = last - size + 1
        if what == "digit":
            if at < run:
                continue
            run = run_end(text, at, DIGITS)
            if at >= done["ip"] and (m := ip_at(text, at)):
                done["ip"] = m[1]
                if m[2]:
                    out["ip"].append(m[:2])
            if at >= done["card"]:
                end, digits = card_at(text, at)
                if len(digits) > 1:
                    done["card"] = end
                    if 13 <= len(digits) <= 19 and luhn(digits):
                        out["card"].append((at, end))
        elif what == "at":
            if at >= done["email"] and (m := email_at(text, at, done["email"])):
                done["email"] = m[1]
                out["email"].append(m)
        elif what == "plus":
            if at >= done["phone"] and (m := phone_at(text, at)):
                done["phone"] = m[1]
                if 9 <= sum(c in DIGITS for c in text[m[0] : m[1]]) <= 15:
                    out["phone"].append(m)
        elif what == "scheme":
            if at >= done["url"] and (m := url_at(text, at, done["url"], urls)):
                done["url"] = m[1]
                out["url"].append(m)
        elif what in ("secret", "bearer"):
            if at >= done["secret"] and (at == 0 or text[at - 1] not in WORD) and (m := secret_at(text, last + 1, secrets, what == "bearer")):
                done["secret"] = m[1]
                out["secret"].append(m)
        elif at >= done["account"] and (at == 0 or text[at - 1] not in WORD) and (m := iban_at(text, last + 1) or account_at(text, last + 1)):
            done["account"] = m[1]
            out["account"].append(m)
    return out


def listed(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in spans[k])


def redacted(text: str | None, spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str | None:
    """text with [EMAIL] and so on in place of the spans; where spans overlap, the union takes the first one's name."""
    marks = sorted((a, -b, k) for k in kinds for a, b in spans[k])
    if not marks:
        return text
    out, at = [], 0
    for a, b, k in marks:
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
        at = max(at, -b)
    return "".join([*out, text[at:]])


SPANS = "array<struct<kind:string,start:int,end:int>>"


def find_pii(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs' `keep` columns with `spans`: an array of (kind, start, end) by kind, then start."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + f", spans {SPANS}"

    def run(b):
        found = [find_spans(t) for t in b.column("__text").to_pylist()]
        got = [[{"kind": k, "start": a, "end": e} for k in (*KINDS, *MORE) for a, e in s[k]] for s in found]
        return {c: b.column(c) for c in keep} | {"spans": got}

    return map_slices(docs.select(*keep, F.col(text).alias("__text")), run, schema)


def pii_digest(docs: DataFrame) -> DataFrame:
    """One row per document with the counts, digest and list of its spans."""
    spans = find_pii(docs)

    def text_of(x):
        return F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))

    def number(kind):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda x: x["kind"].isin(*KINDS))
    return spans.select(
        "doc_id",
        *map(number, KINDS),
        F.sha2(F.concat_ws(",", F.transform(base, text_of)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("spans", text_of)).alias("spans"),
    )


def redact_pii(docs: DataFrame) -> DataFrame:
    """docs, in the same columns, with every span but urls replaced in `text`; n_chars follows the text where it changed."""
    names, kinds = docs.columns, (*KINDS, "account", "secret")
    schema = docs.schema

    def run(batches):
        import pyarrow as pa

        from tracelake.llm.common import slices

        for b in slices(batches):
            texts = b.column("text").to_pylist()
            new = [redacted(t, find_spans(t), kinds) for t in texts]
            cols = {c: b.column(c) for c in names}
            cols["text"] = pa.array(new, b.schema.field("text").type)
            if "n_chars" in names:
                old = b.column("n_chars").to_pylist()
                cols["n_chars"] = pa.array(
                    [o if t == s else len(t) for o, s, t in zip(old, texts, new, strict=True)],
                    b.schema.field("n_chars").type,
                )
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=names)

    return docs.mapInArrow(run, schema)
