"""Personal data: fixed patterns, and what a character tagger finds beyond them.

The tagger is a bidirectional LSTM with CRF transitions (:mod:`char_tagger`), trained on
windows around labelled spans: those of the patterns in a bounded sample of documents,
half of them rewritten the way people veil such data (spelled-out at and dot, bracketed
dots, other separators, no plus). Texts are cut into overlapping windows; scores of
positions that several windows cover are averaged, those far from a window's edge
counting more, and one Viterbi path runs over every connected stretch.

Windows are looked at where a span could be accepted: those with a digit, an @ or the
word "at" before something that reads as a domain with spelled-out or plain dots.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amberline.llm.char_tagger import PAD, Tagger, symbols, train
from amberline.llm.common import map_rows, texts
from amberline.session import materialise

KINDS = ("email", "ip", "card", "phone")
# The contract's patterns. Runs are entered at their first character only,
# which finds the same matches in linear time; an address is looked for from its @.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
HINT = re.compile("[0-9@]")
DIGITS = re.compile("[0-9]")
# an address without digits and @, from its "at" on: every one that holds() accepts has this
# each run of blanks is entered at its first character and left for good, so long runs take linear time
CLOSES, OPENS = r"\s*+(?:[)\]}]\s*+)?", r"\s*+(?:[(\[{]\s*+)?"
SPELLED = re.compile(rf"(?<![A-Za-z0-9-])at\b{CLOSES}[A-Za-z0-9-]+(?:{OPENS}(?:\.|\bdot\b){CLOSES}[A-Za-z0-9-]+)+", re.IGNORECASE)
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
WINDOW, STRIDE = 96, 48
BLOCK_CHARS = 2_000_000
LOWEST = -(2**63)
AT = re.compile(rf"(?<!\s){OPENS}(?:@|(?<![A-Za-z0-9-])at\b){CLOSES}", re.IGNORECASE)
DOT = re.compile(rf"(?<!\s){OPENS}(?:\.|\bdot\b){CLOSES}", re.IGNORECASE)


def luhn(digits: str) -> bool:
    total = 0
    for at, d in enumerate(reversed(digits)):
        v = int(d) * (1 + at % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _good(kind: str, span: str) -> bool:
    digits = "".join(DIGITS.findall(span))
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in span.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the patterns' matches that hold, by start, then kind as listed."""
    found = []
    if "@" in text:
        last = 0
        for m in DOMAIN.finditer(text):
            begin = m.start()
            while begin > last and text[begin - 1] in LOCAL:
                begin -= 1
            if begin < m.start():
                found.append((begin, "email", m.end()))
                last = m.end()
    if DIGITS.search(text):
        for kind, pattern in (("ip", IP), ("card", CARD), ("phone", PHONE)):
            found += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if _good(kind, m[0])]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1])))


def written(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def holds(kind: str, span: str) -> bool:
    """Whether a tagged span, its veil lifted, is of its kind."""
    if "\n" in span or kind != "email" and not HINT.search(span):
        return False
    if kind == "email":
        parts = AT.split(span.strip())
        if len(parts) != 2:
            return False
        plain = "@".join(DOT.sub(".", p) for p in parts)
        return [s[0] for s in base_spans(plain)] == [0] and base_spans(plain)[0][2] == len(plain)
    if kind == "ip":
        plain = DOT.sub(".", span.strip())
        return IP.fullmatch(plain) is not None and _good("ip", plain)
    if re.search(r"[^0-9\s().+/_·-]", span):
        return False
    return _good(kind, span)


def veiled(kind: str, span: str, choice: int) -> str:
    """A span of the kind as people write it to get past a pattern."""
    if kind == "email":
        name, domain = span.split("@")
        return [f"{name} at {domain.replace('.', ' dot ')}", f"{name}(at){domain.replace('.', '(dot)')}", f"{name} [at] {domain}", f"{name} @ {domain}"][choice % 4]
    if kind == "ip":
        return [span.replace(".", "[.]"), span.replace(".", " . "), span.replace(".", " dot ")][choice % 3]
    digits = "".join(DIGITS.findall(span))
    if kind == "card":
        sign = "./_"[choice % 3]
        return sign.join(digits[i:i + 4] for i in range(0, len(digits), 4))
    return [span[1:], "00" + span[1:], span.replace(" ", "/", 1)[1:]][choice % 3]


def _without_digits(address: str) -> str | None:
    """The address with its digits left out; None where that is none."""
    plain = re.sub(r"[._%+-]+(?=@)", "", DIGITS.sub("", address))
    return plain if holds("email", plain) else None


def _shifted(address: str, by: int) -> str:
    """The address with other letters, so that its few names and domains are not learned by heart; of an odd shift without the first label of a long domain."""
    name, domain = address.split("@")
    if by % 2 and domain.count(".") > 1:
        domain = domain.split(".", 1)[1]
    last = domain.rindex(".")
    moved = re.sub("[a-z]", lambda m: chr((ord(m[0]) - 97 + by) % 26 + 97), f"{name}@{domain[:last]}")
    return moved + (domain[last:], ".org", ".net", ".de")[by % 4]


def examples(text: str) -> Iterator[tuple[str, str, bool]]:
    """(window, tags as digits, whether for addresses without digits) around every labelled span, plain and veiled, and around digits and spelled-out dots outside spans."""
    spans, last = [], -1
    for start, kind, end in base_spans(text):
        if start >= last:  # of overlapping spans the first
            spans.append((start, kind, end))
            last = end
    for at, (start, kind, end) in enumerate(spans):
        if end - start > WINDOW // 2:
            continue
        shift = (start * 7 + at) % (WINDOW - (end - start))
        forms = [(text[start:end], False), (veiled(kind, text[start:end], start + at), False)]
        if kind == "email":  # the given addresses may all hold digits; others need not
            plain = _without_digits(text[start:end])
            forms += [(veiled(kind, _shifted(plain, (start + at) * choice), choice), True) for choice in range(3)] if plain else []
        for changed, spelled in forms:
            whole = text[:start] + changed + text[end:]
            begin = max(0, start - shift)
            window = whole[begin:begin + WINDOW]
            moved = len(changed) - (end - start)
            tags = np.zeros(WINDOW, int)
            for s, k, e in spans:
                if s > start:
                    s, e = s + moved, e + moved
                elif s == start:
                    e += moved
                a, b = s - begin, min(e - begin, WINDOW)
                if 0 <= a < WINDOW:
                    tags[a:b] = 2 + 2 * KINDS.index(k)
                    tags[a] -= 1
                elif a < 0 < b:
                    tags[:b] = 2 + 2 * KINDS.index(k)
            yield window, "".join(map(str, tags)), spelled
    covered = {p for s, _, e in spans for p in range(s, e)}
    for m in [*list(re.finditer("[0-9]+", text))[:8], *list(SPELLED.finditer(text))[:2]]:
        if m.start() not in covered and not any(p in covered for p in range(max(0, m.start() - WINDOW), m.start() + WINDOW)):
            begin = max(0, m.start() - WINDOW // 2)
            yield text[begin:begin + WINDOW], "0" * WINDOW, m.re is SPELLED


def train_tagger(docs: DataFrame, sample_docs: int = 1_000, windows: int = 1_500, epochs: int = 8) -> Tagger | None:
    """A tagger fitted to at most ``windows`` windows of at most ``sample_docs`` documents with a digit or @, and as many for addresses without digits.

    Both samples go by a hash of the content and take equal texts once, so they don't
    depend on the order, partitioning or copies of rows. None where no document has a
    labelled span.
    """
    found = texts(docs).select("text", F.xxhash64("text").alias("rank")).where(F.col("text").rlike("[0-9@]"))
    # the ranks alone go through one task, the texts they belong to stay where they are
    ranks = [r["rank"] for r in found.select("rank").distinct().orderBy("rank").limit(sample_docs).collect()]
    some = found.where(F.col("rank") <= (ranks[-1] if ranks else LOWEST)).dropDuplicates(["rank"]).select("text")

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for text, in rows:
            yield from examples(text)

    found = materialise(map_rows(some, run, "window string, tags string, spelled boolean"), "tagger-windows")
    ordered = found.orderBy(F.xxhash64("window", "tags"), "window")
    rows = [r for spelled, n in ((False, windows), (True, windows)) for r in ordered.where(F.col("spelled") == spelled).limit(n).collect()]
    if not any(set(r["tags"]) - {"0"} for r in rows):
        return None
    codes = np.full((len(rows), WINDOW), PAD, np.uint8)
    for at, r in enumerate(rows):
        own = symbols(r["window"])
        codes[at, :len(own)] = own
    return train(codes, np.array([[int(c) for c in r["tags"]] for r in rows]), TAGS, epochs=epochs)


def tagged_spans(found: list[str], tagger: Tagger, at_once: int = 1_024) -> list[list[tuple[int, str, int]]]:
    """Per text the tagger's spans that hold, decoded over overlapping windows."""
    weight = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)[:, None]
    windows: list[tuple[int, int, np.ndarray]] = []  # text, start, symbols
    for which, text in enumerate(found):
        hints = np.array([m.start() for m in HINT.finditer(text)] + [
            p for m in SPELLED.finditer(text) for p in (*range(m.start(), m.end(), STRIDE), m.end() - 1)])
        if not len(hints):
            continue
        # windows begin at multiples of the stride; every one with a hint in it is looked at
        last = max(0, -(-(len(text) - WINDOW) // STRIDE))
        starts = np.unique(np.concatenate([np.clip(hints // STRIDE - k, 0, last) for k in range(WINDOW // STRIDE)])) * STRIDE
        codes = symbols(text)
        windows += [(which, s, codes[s:s + WINDOW]) for s in starts.tolist()]
    out: list[list[tuple[int, str, int]]] = [[] for _ in found]
    stretch: list[tuple[int, np.ndarray]] = []  # neighbouring windows of one text: start, scores

    def reconcile(which: int) -> None:
        begin, end = stretch[0][0], min(stretch[-1][0] + WINDOW, len(found[which]))
        total, weights = np.zeros((end - begin, TAGS), np.float32), np.zeros((end - begin, 1), np.float32)
        for s, scores in stretch:
            n = min(WINDOW, end - s)
            total[s - begin:s - begin + n] += (scores * weight)[:n]
            weights[s - begin:s - begin + n] += weight[:n]
        out[which].extend(_spans_of(tagger.decode(total / weights), found[which], begin))
        stretch.clear()

    before = (-1, 0)
    for first in range(0, len(windows), at_once):
        some = windows[first:first + at_once]
        codes = np.full((len(some), WINDOW), PAD, np.uint8)
        for row, (_, _, own) in zip(codes, some):
            row[:len(own)] = own
        for (which, s, _), scores in zip(some, tagger.emissions(codes)):
            if stretch and (which != before[0] or s >= before[1] + WINDOW):
                reconcile(before[0])
            stretch.append((s, scores))
            before = (which, s)
    if stretch:
        reconcile(before[0])
    return out


def _spans_of(path: np.ndarray, text: str, begin: int) -> list[tuple[int, str, int]]:
    kinds = np.where(path > 0, (path + 1) // 2, 0)
    edges = np.flatnonzero((np.diff(kinds, prepend=0) != 0) | (path % 2 == 1))
    out = []
    for at, start in enumerate(edges):
        if kinds[start]:
            end = int(edges[at + 1]) if at + 1 < len(edges) else len(path)
            inside = text[begin + start:begin + end]
            start, end = begin + start + len(inside) - len(inside.lstrip()), begin + end - len(inside) + len(inside.rstrip())
            kind = KINDS[kinds[edges[at]] - 1]
            if start < end and holds(kind, text[start:end]):
                out.append((int(start), kind, int(end)))
            elif start < end and kind == "email" and (whole := _completed(text, int(start), int(end))) and (not out or out[-1][2] <= whole[0]):
                out.append((whole[0], kind, whole[1]))
    return out


def _completed(text: str, start: int, end: int) -> tuple[int, int] | None:
    """The spelled-out address that a span tagged as e-mail covers at least half of; the tagger's edges may lie within a word."""
    for m in SPELLED.finditer(text, max(0, start - 1), min(len(text), end + WINDOW)):
        stop = m.start()
        name = stop - (stop - len(text[:stop].rstrip(" \t([{")) if stop > max(0, start - WINDOW) else 0)
        begin = name
        while begin > max(0, start - WINDOW) and text[begin - 1] in LOCAL:
            begin -= 1
        shared = min(end, m.end()) - max(start, begin)
        if begin < name and 2 * shared >= m.end() - begin and holds("email", text[begin:m.end()]):
            return begin, m.end()
    return None


def all_spans(found: list[str], tagger: Tagger | None) -> Iterator[tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]]:
    """Per text the base spans, and all: those and the tagger's that touch none of them."""
    tagged = tagged_spans(found, tagger) if tagger else [[] for _ in found]
    for text, more in zip(found, tagged):
        base = base_spans(text)
        more = [s for s in more if not any(s[0] < e and b < s[2] for b, _, e in base)]
        yield base, sorted({*base, *more}, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


def _blocks(rows: Iterator[tuple], at: int) -> Iterator[list[tuple]]:
    """Rows in blocks of bounded text."""
    block, held = [], 0
    for row in rows:
        block.append(row)
        held += len(row[at] or "") + 200
        if held >= BLOCK_CHARS:
            yield block
            block, held = [], 0
    if block:
        yield block


def find(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every row.

    Offsets count code points, ends are exclusive. A null or empty text has no span.
    Rows are judged by themselves, so repeated ones give repeated results. The tagger
    defaults to one trained on ``docs``; its weights (about 20,000 numbers) go with the
    job. An empty table gives no row.
    """
    tagger = tagger or train_tagger(docs)

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for block in _blocks(rows, 1):
            for (doc_id, _), (base, spans) in zip(block, all_spans([text for _, text in block], tagger)):
                counts = [sum(k == kind for _, k, _ in base) for kind in KINDS]
                yield doc_id, *counts, hashlib.sha256(written(base).encode()).hexdigest(), written(spans), len(spans) - len(base)

    return map_rows(texts(docs), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redact(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets and ``n_chars`` counted anew; all rows stay.

    Of overlapping spans the first is replaced, and what of the others reaches beyond it
    goes with it. Null texts stay null, with their n_chars.
    """
    tagger = tagger or train_tagger(docs)
    columns = docs.columns
    at = columns.index("text")

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for block in _blocks(rows, at):
            for row, (_, spans) in zip(block, all_spans([row[at] or "" for row in block], tagger)):
                yield _redacted(row, spans) if spans else row

    def _redacted(row: tuple, spans: list[tuple[int, str, int]]) -> tuple:
        text, parts, last = row[at], [], 0
        for start, kind, end in spans:
            if start >= last:
                parts += [text[last:start], f"<{kind}>"]
            last = max(last, end)
        clean = "".join(parts) + text[last:]
        changed = {"text": clean, "n_chars": len(clean)}
        return tuple(changed.get(name, value) for name, value in zip(columns, row))

    return map_rows(docs, run, docs.schema)
