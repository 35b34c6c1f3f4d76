"""Personal data: exact base patterns, plus offset-preserving deobfuscation.

Base spans come from plain patterns over the source text. For disguised identifiers, a chain of
transducers rewrites the whole text (look-alike letters, foreign or spelled digits, invisible
characters, written-out "at" and "dot"), and each step keeps the places of what it replaced. The same
detectors then run over the rewritten text, and what they find is mapped back, step by step, to source
characters. No step looks only so far, and each takes time in proportion to the text.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect, bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, map_texts, slices, worker_state

KINDS = ("email", "ip", "card", "phone")

_LOCAL, _HOST = "A-Za-z0-9._%+-", "A-Za-z0-9-"
_MAIL = rf"[{_LOCAL}]++@[{_HOST}]++(?:\.[{_HOST}]++)++"
_MAIL_HERE, _MAIL_NEXT = re.compile(_MAIL), re.compile(rf"(?<![{_LOCAL}]){_MAIL}")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    twice = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[::-2])) + sum(d - 9 if d > 9 else d for d in twice)) % 10 == 0


def _emails(text: str):
    """Leftmost non-overlapping: a match starts where a run of local characters or the last match ends."""
    at = 0
    while found := (_MAIL_HERE.match(text, at) if at else None) or _MAIL_NEXT.search(text, at):
        yield found.span()
        at = found.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every base pattern, in order; failing matches are dropped, not retried."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.groups())]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return sorted(out)


# Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ɡ": "g", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "п": "n", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "。": ".", "․": ".", "٠": "0",
}
# Digit words of the four languages of the corpus.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}

# Last labels of mail hosts that need no written-out dot before them, and words that stand before a place on the web.
_ENDINGS = frozenset("com org net edu gov mil info biz io dev app ai eu de at ch fr es it nl be pl uk ie us ca mx br ar cl co jp cn in au nz ru".split())
_BEFORE_PLACES = frozenset("look looking find found see seen visit here us me it them is are was were be available hosted live online read more page site website blog shop store documentation docs code download downloads listed published posted".split())

_WORD = "(?=[" + "".join(sorted({w[0] for w in DIGIT_WORDS})) + "])(?:" + "|".join(sorted(DIGIT_WORDS, key=lambda w: (-len(w), w))) + ")"
_SPELLED = re.compile(rf"(?<!\w)(?:{_WORD})(?:[\s,.-]{{1,3}}(?:{_WORD})){{2,}}(?!\w)", re.I)
_ONE_WORD = re.compile(rf"(?<!\w)(?:{_WORD})(?!\w)", re.I)
_SPELLED_GAP = re.compile(r",\x20?|\x20{2,3}")
# Digit words among figures: between them, or joined to them without white space.
_LOOSE = rf"(?<![^\W\d_])(?:{_WORD})(?![^\W\d_])"
_LOOSE_WORD = re.compile(_LOOSE, re.I)
_MIXED = re.compile(rf"(?<=[0-9])(?:[\s,.-]{{0,3}}{_LOOSE})+[\s,.-]{{0,3}}(?=[0-9])|(?<=[0-9])(?:[.-]?{_LOOSE})+(?![\w-])|(?<![\w.-]){_LOOSE}(?:[.-]?{_LOOSE})*[.-]?(?=[0-9])", re.I)
_PLUS = re.compile(r"(?<!\w)plus\s++(?=[0-9])", re.I)
_AT_WORD, _DOT_WORD = "at|arroba|ät|@", r"dot|punkt|punto|point|\."
_BOXED = re.compile(rf"[\[({{<]\s*+(?:(?P<at>{_AT_WORD})|{_DOT_WORD})\s*+[\])}}>]", re.I)
_SAID_DOT = r"\s++(?:dot|punkt|punto|point)\s++"
# "at" after a mailbox, then labels joined by written-out or plain dots; whatever comes last, so it never has to step back.
_SAID_AT = re.compile(rf"(?<=[\w.%+-])(?:\s++(?:at|arroba)\s++|@)(?P<host>[\w-]++(?:(?:{_SAID_DOT}|\.)[\w-]++)++)", re.I)
_JOINT = re.compile(rf"{_SAID_DOT}|\.", re.I)
_IP_DOT = re.compile(rf"(?<=[0-9]){_SAID_DOT}(?=[0-9])", re.I)
_HINTS = ("dot", "punkt", "punto", "point", "at", "ät", "arroba")
_INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
_ODD_SET = f"[{_INVISIBLE}Ͱ-ԯ٠-٩۰-۹०-९‐-–․−。！-～｡﹒﹫\U0001d400-\U0001d7ff]"
_ODD = re.compile(_ODD_SET)


def _fold(c: str) -> str:
    if c in _INVISIBLE:
        return ""
    if (d := unicodedata.decimal(c, None)) is not None:
        return str(d)
    return LOOKALIKES.get(c) or unicodedata.normalize("NFKC", c)


def _fold_tables() -> tuple[dict[int, str], re.Pattern]:
    """What folds to one character, and a pattern for what changes length."""
    odd = [chr(c) for c in range(0x1D800) if not 0xD800 <= c < 0xE000 and _ODD.match(chr(c))]
    folded = {c: _fold(c) for c in odd}
    return {ord(c): f for c, f in folded.items() if len(f) == 1 and f != c}, re.compile("[" + "".join(c for c, f in folded.items() if len(f) != 1) + "]")


_FOLD, _RESIZED = _fold_tables()


class Tape:
    """A text after some rewriting steps, and the way back to its source."""

    def __init__(self, text: str, steps: tuple = ()):
        self.text, self.steps = text, steps

    def rewrite(self, changes: list[tuple[int, int, str]]) -> Tape:
        """Replace each stretch [a, b) by a string; changes are in order, disjoint and not empty."""
        parts, new_starts, new_ends, old_starts, old_ends, at, size = [], [], [], [], [], 0, 0
        for a, b, new in changes:
            parts += [self.text[at:a], new]
            size += a - at
            new_starts.append(size)
            size += len(new)
            new_ends.append(size)
            old_starts.append(a)
            old_ends.append(b)
            at = b
        if not at:
            return self
        parts.append(self.text[at:])
        return Tape("".join(parts), (*self.steps, (new_starts, new_ends, old_starts, old_ends)))

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The source stretch of [start, end): a replaced stretch counts whole."""
        for new_starts, new_ends, old_starts, old_ends in reversed(self.steps):
            i = bisect(new_starts, start) - 1
            if i >= 0:
                start = old_starts[i] if start < new_ends[i] else start - new_ends[i] + old_ends[i]
            i = bisect(new_starts, end - 1) - 1
            if i >= 0:
                end = old_ends[i] if end - 1 < new_ends[i] else end - new_ends[i] + old_ends[i]
        return start, end


def _boxed(text: str):
    """Boxed at and dot, with the white space on both sides."""
    done = 0
    for m in _BOXED.finditer(text):
        a, b = m.span()
        while a > done and text[a - 1].isspace():
            a -= 1
        while b < len(text) and text[b].isspace():
            b += 1
        yield a, b, "@" if m["at"] else "."
        done = b


def _local(c: str) -> bool:
    return c.isalnum() or c in "._%+-"


def _said(text: str):
    """Written-out at and dots between a mailbox and a host, as changes.

    The host ends in a label of two letters or more after a written-out dot, or, if no dot is written
    out, in a common ending, and then the word before is not one that often stands before a place.
    """
    done = 0
    for m in _SAID_AT.finditer(text):
        gap, (host, last) = m.start(), m.span("host")
        joints = [x.span() for x in _JOINT.finditer(text, host, last)]
        said = any(b - a > 1 for a, b in joints)
        if host - gap == 1 and not said:  # a plain at sign and plain dots
            continue
        end = last
        while said and joints and not (end - joints[-1][1] > 1 and text[joints[-1][1] : end].isascii() and text[joints[-1][1] : end].isalpha()):
            end = joints.pop()[0]
        dots, i = [], gap
        while i > done:
            j = i
            while j > done and _local(text[j - 1]):
                j -= 1
            k = j
            while k > done and text[k - 1].isspace():
                k -= 1
            word = next((w for w in ("dot", "punkt", "punto", "point") if text[max(done, k - len(w)) : k].lower() == w), None)
            if word is None or k == j:
                break
            q = r = k - len(word)
            while r > done and text[r - 1].isspace():
                r -= 1
            if r == q or r == done or not _local(text[r - 1]):
                break
            dots.append((r, j, "."))
            i = r
        if not said and not dots:
            before = gap
            while before > done and _local(text[before - 1]):
                before -= 1
            ending, first = text[joints[-1][1] : end], text[host : joints[0][0]]
            if ending.lower() not in _ENDINGS or first.lower() == "www" or text[before:gap].lower() in _BEFORE_PLACES:
                joints = []
        done = m.end()
        if joints:
            yield from reversed(dots)
            yield gap, host, "@"
            yield from ((a, b, ".") for a, b in joints if b - a > 1)


def _digits(text: str, spans: list[tuple[int, int]], words: re.Pattern, gaps: re.Pattern | None = None):
    """Digit words inside the spans, and the gaps between them that match."""
    for a, b in spans:
        at = None
        for m in words.finditer(text, a, b):
            if gaps and at is not None and gaps.fullmatch(text, at, m.start()):
                yield at, m.start(), " "
            yield *m.span(), DIGIT_WORDS[m[0].lower()]
            at = m.end()


def normalise(text: str) -> tuple[Tape, Tape]:
    """The chain: look-alikes and invisible characters, boxed and said at/dot, spelled digits; then also those among figures."""
    if not text.isascii() and _ODD.search(text):
        tape = Tape(text.translate(_FOLD)).rewrite([(*m.span(), _fold(m[0])) for m in _RESIZED.finditer(text)])
    else:
        tape = Tape(text)
    low = tape.text.lower()
    if any(w in low for w in _HINTS) or _BOXED.search(tape.text):
        tape = tape.rewrite(list(_boxed(tape.text)))
        tape = tape.rewrite(list(_said(tape.text)))
    spelled = [m.span() for m in _SPELLED.finditer(tape.text)]
    if spelled:
        tape = tape.rewrite(list(_digits(tape.text, spelled, _ONE_WORD, _SPELLED_GAP)))
    mixed = tape
    if _DIGIT.search(tape.text):
        found = [m.span() for m in _MIXED.finditer(tape.text)]
        mixed = tape.rewrite(list(_digits(tape.text, found, _LOOSE_WORD)))

    def ending(t: Tape) -> Tape:
        t = t.rewrite([(*m.span(), ".") for m in _IP_DOT.finditer(t.text)])
        return t.rewrite([(*m.span(), "+") for m in _PLUS.finditer(t.text)])

    first = ending(tape)
    return first, first if mixed is tape else ending(mixed)


def added_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Disguised identifiers. One that touches a base span counts only if it widens one of its own kind."""
    tapes = normalise(text)
    kinds = [[(x, y) for x, k, y in base if k == kind] for kind in range(len(KINDS))]  # disjoint within a kind

    def touching(start: int, end: int):
        for k, spans in enumerate(kinds):
            i = max(0, bisect_left(spans, (start, start)) - 1)
            while i < len(spans) and spans[i][0] < end:
                if start < spans[i][1]:
                    yield k, *spans[i]
                i += 1

    out = set()
    for i, tape in enumerate(tapes):
        if tape.text == text or (i and tape is tapes[0]):
            continue
        for s, kind, e in base_spans(tape.text):
            start, end = tape.source(s, e)
            near = list(touching(start, end))
            if not near or any(k == kind and start <= x and y <= end and (x, y) != (start, end) for k, x, y in near):
                out.add((start, kind, end))
    return sorted(out)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", masked: bool = False) -> DataFrame:
    """(doc_id, spans[, masked]): spans of personal data in code points, end exclusive, by start and kind.

    spans: array<struct<kind, start, end, base>>; base tells plain findings from deobfuscated ones.
    With `masked` the text is returned too, each covered stretch replaced by the name of its first kind
    in brackets. A null or empty text has no spans and an empty masked text; equal ids each keep their
    row; other columns are not read; an empty table gives no rows. Whole texts are searched, in time in
    proportion to their length. What the added spans ask: spelled digits stand three in a row with one to
    three separators between, or among figures with three at most; a host with written-out dots ends in
    two letters or more, one after a plain "at" in a common ending.
    """

    def make():
        def run(ids, texts):
            out = {"doc_id": ids, "spans": []} | ({"masked": []} if masked else {})
            for text in texts:
                base = base_spans(text)
                more = added_spans(text, base)
                found = sorted([(*s, True) for s in base] + [(*s, False) for s in more])
                out["spans"].append([{"kind": KINDS[k], "start": a, "end": b, "base": plain} for a, k, b, plain in found])
                if masked:
                    out["masked"].append(mask(text, found))
            return out

        return run

    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs, make, f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int,base:boolean>>" + ", masked string" * masked, id_col, text_col)


def mask(text: str, spans: list[tuple]) -> str:
    """Replace every stretch that overlapping spans cover together by [KIND] of its first span."""
    parts, at, i = [], 0, 0
    while i < len(spans):
        a, kind, b = spans[i][:3]
        i += 1
        while i < len(spans) and spans[i][0] < b:
            b = max(b, spans[i][2])
            i += 1
        parts += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = b
    return "".join(parts) + text[at:] if parts else text


def mask_column(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with personal data in the text column masked, whatever its length; all other columns, null texts and repeated rows stay."""

    def run(batches):
        import pyarrow as pa

        worker_state("")
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for part in slices(batch, text_col):
                out = []
                for text in part.column(at).to_pylist():
                    base = base_spans(text) if text else []
                    out.append(mask(text, sorted(base + added_spans(text, base))) if text else text)
                columns = [pa.array(out, part.schema.field(at).type) if i == at else c for i, c in enumerate(part.columns)]
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)
                del out, columns
        give_back()

    return docs.mapInArrow(run, docs.schema)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined in their order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
