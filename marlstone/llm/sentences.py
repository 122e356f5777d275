"""Sentence units of texts in many languages and scripts.

A lexer marks the events of a text (runs of closing marks, quotation marks, paragraph and item ends)
and tells for each the classes of what stands on both sides. A finite transducer, compiled once from
the boundary rules, reads mark and classes as one symbol: its state is the quotation that is open,
and its output says which events end a unit. What a rule needs to know of the rest of the paragraph
(whether a quotation is ever closed) the lexer reads off an index of the marks made in one pass.

The transducer runs over chunks of the event stream: every chunk becomes a function from entry to
exit state, the functions are composed by a parallel prefix scan, and with the entry states known all
chunks emit at once. Long texts are cut into chunks that are rows of their own, so that one text
spreads over many tasks; their functions are composed the same way. Time is linear in the length.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.session import durable

# Abbreviations (lower case, without the last period) after which no unit ends.
NEVER = set(
    (
        "mr mrs ms dr prof st sr jr gen col sgt capt lt rev hon bros approx vs cf e.g i.e viz fig figs sec secs vol pp ed eds "
        "bzw ggü inkl exkl zzgl vgl evtl ggf ca nr abs art hr fr dipl ing str mio mrd tsd sog z.b d.h u.a s.o "
        "m mm mme mmes mlle env p.ex ex chap av "
        "sra srta srs sres dra dña aprox p.ej ej pág núm vds ud uds "
        "т.е тыс млн млрд им ул гл рис см "
        "κ κα κ.κ δρ π.χ αρ σελ "
        "د أ م ص डॉ श्री सुश्री"
    ).split()
)
# Single small letters that abbreviate a word (others, as a unit of time, may end a unit).
SMALL = set("z d u m p n v e i t т п с г κ π μ".split())
# Abbreviations after which no unit ends before a number.
BEFORE_NUMBER = set("no nos nr p п jan feb mar apr jun jul aug sept sep oct nov dec art n ch".split())
# German month names, which follow an ordinal's period.
GERMAN_MONTHS = set("januar jänner februar märz april mai juni juli august september oktober november dezember".split())

_THAI = "ก-๎"
_TERM = ".!?…‥。！？｡．।॥؟۔;"
_FULL = set("。！？｡．।॥")
_CLOSE = ")]）】"
_QUOTES = "\"“”„«»「」『』"
_OPENERS = set("“„«「『\"‘([（【¿¡")
_ANY = rf"[\n{re.escape(_TERM.replace(';', ''))}{_QUOTES}]"
#: Where an event may be: its first character; semicolons in Greek only, and blanks after a letter in Thai.
_EVENT = re.compile(_ANY)
_EVENT_WIDE = re.compile(rf"{_ANY}|;|(?<=[{_THAI}])[^\S\n]")
_WIDE = re.compile(rf"[{_THAI}]|[Ͱ-Ͽἀ-῾];")
_PARA = re.compile(r"\n[^\S\n]*\n\s*")
_MARKS_RUN = re.compile(rf"[{re.escape(_TERM)}]+[{re.escape(_CLOSE)}]*")
_BLANKS = re.compile(r"\s*")
_LEFT = re.compile(r"[^\s(\[{\"“„«‘/—–]*$")
_ITEM = re.compile(r"[^\S\n]*(?:([•◦‣▪*\-])|\(?(\d{1,3})[.)])[^\S\n]")
_CAMEL = re.compile(r"[a-z]{1,4}[A-Z]")
_CAMEL_WORD = re.compile(r"[a-z]{1,4}[A-Z][a-z]+[ ,]")
_WORD = re.compile(r"[^\W\d_]+")
_FOREIGN_END = re.compile(rf"[^{_THAI}\n]*")
_BEHIND = re.compile(r"[”»」』)\]）】]*")
_QUOTE = re.compile(f"[{_QUOTES}]")

# ---- the transducer -----------------------------------------------------------------------------------------

OUT, DOUBLE, LOW, ANGLE, CORNER, WHITE, STRAIGHT, REVERSED = range(8)
STATES = 8
RESET, TERM, NONE = 0, 1, 2
_MARKS = ["“", "”", "„", "«", "»", "「", "」", "『", "』", '"', "»open"]

# Classes of a run of closing marks: a full stop of a script that needs no blank, one period, a period
# before closing brackets, a question or exclamation, the Arabic question, any other.
FULL, DOT, DOT_CLOSED, ASK, ASK_ARABIC, OTHER = range(6)
# Classes of the word before it: nothing of note, an abbreviation, one only before a number, the number
# of a list item, a number of up to two digits.
PLAIN, SHORT, SHORT_BEFORE_NUMBER, ITEM, ORDINAL = range(5)
# Classes of what follows after blanks (nothing that begins a unit, a month, a number, another beginning)
# and of what follows at once.
NO_START, MONTH, NUMBER, START, OPEN, KANA, UPPER, DIGIT, CASELESS, CAMEL, ELSE = range(11)
# Flags of the word before a mark that no blank follows: it may not end there, its last character may
# stand before an end, and how long it is.
BLOCKED, ENDABLE, LONG, MORE_THAN_ONE, THREE_LETTERS = 1, 2, 4, 8, 16
# Classes of the last solid character before a quotation mark: no closing mark, one of . ! ? …, another.
OPEN_END, WESTERN_END, OTHER_END = range(3)
# Classes of what follows a quotation mark: a unit may begin after blanks or the text ends, none may, at
# once an opening mark, a capital, something else.
AFTER_START, AFTER_NO, AFTER_OPEN, AFTER_UPPER, AFTER_ELSE = range(5)


def _ends_spaced(mark: int, word: int, after: int) -> bool:
    if mark == FULL:
        return True
    short = word in (SHORT, ITEM) or word == SHORT_BEFORE_NUMBER and after == NUMBER or word == ORDINAL and after == MONTH
    return after != NO_START and not (mark == DOT and short)


def _ends_joined(mark: int, flags: int, after: int) -> bool:
    if mark == FULL:
        return True
    if after == KANA:
        return mark in (ASK, ASK_ARABIC)
    if mark in (DOT, DOT_CLOSED) and flags & BLOCKED or not flags & ENDABLE:
        return False
    return after == UPPER or bool({DIGIT: LONG, CASELESS: MORE_THAN_ONE, CAMEL: THREE_LETTERS}.get(after, 0) & flags)


def _ends_quote(mark: str, before: int, after: int) -> bool:
    """Whether a unit can end with a quotation mark, should it close a quotation."""
    if before == OPEN_END:
        return False
    return after == AFTER_START or after == AFTER_OPEN and mark in "”」』»" or after == AFTER_UPPER and before == WESTERN_END


def _compile() -> tuple[dict, np.ndarray, np.ndarray]:
    """Number of each (kind, classes) and, by number and state, the next state and the output (1: a unit ends here)."""
    rules: list[tuple[tuple, bool]] = [(("reset",), True), (("end",), True), (("none",), False)]
    rules += [(("spaced", m, w, a), _ends_spaced(m, w, a)) for m in range(6) for w in range(5) for a in (NO_START, MONTH, NUMBER, START)]
    rules += [(("open", m, w), m == FULL or not (m in (DOT, DOT_CLOSED) and w == SHORT)) for m in range(6) for w in range(5)]
    rules += [(("joined", m, f, a), _ends_joined(m, f, a)) for m in range(6) for f in range(32) for a in range(KANA, ELSE + 1)]
    rules += [(("quote", q, b, a), _ends_quote(q[0], b, a)) for q in _MARKS for b in range(3) for a in range(5)]
    number = {key: k for k, (key, _) in enumerate(rules)}
    step = np.tile(np.arange(STATES, dtype=np.int8), (len(rules), 1))
    emit = np.zeros((len(rules), STATES), dtype=np.int8)
    step[RESET] = OUT
    opens = {"“": DOUBLE, "„": LOW, "«": ANGLE, "「": CORNER, "『": WHITE, '"': STRAIGHT, "»open": REVERSED}
    closes = {"”": (DOUBLE, LOW, OUT), "“": (LOW,), "»": (ANGLE, OUT), "«": (REVERSED,), "」": (CORNER, OUT), "』": (WHITE, OUT), '"': (STRAIGHT,)}
    for key, ends in rules:
        k = number[key]
        if key[0] != "quote":
            emit[k, :] = ends if key[0] == "reset" else 0
            emit[k, OUT] = ends
            continue
        if key[1] in opens:
            step[k, OUT] = opens[key[1]]
        for state in closes.get(key[1], ()):
            step[k, state], emit[k, state] = OUT, ends
    return number, step, emit


NUMBER_OF, STEP, EMIT = _compile()


def transition(symbols: np.ndarray) -> np.ndarray:
    """The function from entry to exit state of a stream, by halving it: neighbours are composed until one is left."""
    f = STEP[symbols].astype(np.int64) if len(symbols) else np.arange(STATES)[None]
    while len(f) > 1:
        if len(f) % 2:
            f = np.concatenate([f, np.arange(STATES)[None]])
        f = np.take_along_axis(f[1::2], f[::2], axis=1)
    return f[0]


def entry_states(functions: np.ndarray, state: int = OUT) -> np.ndarray:
    """State in which each of the consecutive functions (rows) is entered, by a parallel prefix scan."""
    f = np.asarray(functions, dtype=np.int64)
    reach = 1
    while reach < len(f):  # f[c] becomes the composition of the functions c - 2 reach + 1 .. c
        f = np.concatenate([f[:reach], np.take_along_axis(f[reach:], f[:-reach], axis=1)])
        reach *= 2
    return np.concatenate([[state], f[:-1, state]]).astype(np.int64)


def run_transducer(symbols: np.ndarray, chunk: int = 128, state: int = OUT) -> np.ndarray:
    """Output for each symbol of a stream entered in ``state``; by chunks and a prefix scan."""
    n = len(symbols)
    if not n:
        return np.zeros(0, dtype=np.int8)
    chunks = -(-n // chunk)
    grid = np.full(chunks * chunk, NONE, dtype=np.int64)
    grid[:n] = symbols
    grid = grid.reshape(chunks, chunk)
    f = np.tile(np.arange(STATES), (chunks, 1))
    for k in range(chunk):
        f = STEP[grid[:, k, None], f]
    now = entry_states(f, state)
    out = np.empty((chunks, chunk), dtype=np.int8)
    for k in range(chunk):
        out[:, k] = EMIT[grid[:, k], now]
        now = STEP[grid[:, k], now].astype(np.int64)
    return out.reshape(-1)[:n]


# ---- classes ------------------------------------------------------------------------------------------------


def _starts(text: str, at: int) -> bool:
    """Whether a unit may begin at ``at``: capital, number, opening mark, caseless script, or a name like zkX."""
    c = text[at]
    if c.isupper() or c.isdigit() or c in _OPENERS or c.istitle():
        return True
    if c.isalpha():
        return not c.islower() or bool(_CAMEL.match(text, at))
    return c in "$€£¥#@•"


def _greek(c: str) -> bool:
    return "Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῾"


def _mark_class(text: str, a: int, b: int) -> int | None:
    """Class of a run of closing marks; None for one that closes nothing, as most semicolons."""
    marks = text[a:b].rstrip(_CLOSE)
    if marks == ".":
        return DOT if b - a == 1 else DOT_CLOSED
    if marks[0] == ";" and (len(marks) > 1 or not _greek(text[a - 1 : a])):
        return None
    if _FULL.intersection(marks):
        return FULL
    return ASK if marks[-1] in "!?" else ASK_ARABIC if marks[-1] == "؟" else OTHER


def _word_class(text: str, dot: int, heads: set[int]) -> int:
    """Class of the word whose last character stands before the period at ``dot``."""
    left = _LEFT.search(text, max(0, dot - 24), dot).group()
    glued = re.fullmatch(r".*(?:[^\W\d_]{3}|[\d%)])[.!?…]+([^\W\d_]+)", left)
    left = glued.group(1) if glued else left  # the blank before it is missing
    word = left.lower()
    if not word:
        return PLAIN
    if word in NEVER or word in ("п", "p"):
        return SHORT
    other = SHORT_BEFORE_NUMBER if word in BEFORE_NUMBER else PLAIN
    if word == "г":
        return other if re.search(r"\d\s$", text[max(0, dot - 4) : dot - 1]) else SHORT
    if len(left) == 1 and left.isalpha():
        chained = re.search(r"(?:^|\s)[^\W\d_]\.\s?$", text[max(0, dot - 5) : dot - 1])
        return SHORT if not left.islower() or left in SMALL or chained else other
    if left[-1].islower() and not left.isascii() and re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]", left):
        return SHORT
    if word.isdigit() and len(word) <= 3:
        return ITEM if dot - len(word) in heads else ORDINAL if len(word) <= 2 else other
    return other


def _joined_flags(text: str, a: int, mark: int) -> int:
    """Flags of the word before marks that no blank follows."""
    word = _LEFT.search(text, max(0, a - 24), a).group()
    alone = len(word) < 2 and not (word.isdigit() or word == "%" or word.islower() and word not in SMALL and text[a - 3 : a - 2].isdigit())
    k = a - 1
    while mark == ASK and k >= 0 and text[k].isspace():
        k -= 1
    before = text[k] if k >= 0 else ""
    flags = BLOCKED * (alone or word.lower() in NEVER or any(x in word for x in "/@_=\\"))
    flags |= ENDABLE * bool(before and (before.islower() or before.isdigit() or before in "%" + _CLOSE or before.isalpha() and before.lower() == before.upper()))
    flags |= LONG * (word.isalpha() and len(word) > 3 and word.lower() not in BEFORE_NUMBER) | MORE_THAN_ONE * (len(word) > 1)
    return flags | THREE_LETTERS * (word.isalpha() and len(word) > 2)


def _end_symbol(text: str, a: int, b: int, heads: set[int]) -> int:
    """Symbol of the closing marks ``text[a:b]`` with the classes of their surroundings."""
    mark = _mark_class(text, a, b)
    if mark is None or b >= len(text):
        return NONE  # the end of the text ends the unit anyway
    c = text[b]
    if c in "”»」』" or c in '"“' and not text[b + 1 : b + 2].isalnum():
        return NONE  # the closing quotation mark decides
    if mark == FULL:
        return TERM
    if c.isspace():
        nxt = _BLANKS.match(text, b).end()
        if nxt >= len(text) or text[nxt] in "»”」』" or not _starts(text, nxt):
            return NUMBER_OF["spaced", mark, PLAIN, NO_START]
        word = _word_class(text, a, heads) if mark == DOT else PLAIN
        after = NUMBER if text[nxt].isdigit() else START
        if word == ORDINAL and (m := _WORD.match(text, nxt)) and m.group().lower() in GERMAN_MONTHS:
            after = MONTH
        return NUMBER_OF["spaced", mark, word, after]
    if c in "“\"„«「『(（":
        return NUMBER_OF["open", mark, _word_class(text, a, set()) if mark in (DOT, DOT_CLOSED) else PLAIN]
    if "぀" <= c <= "鿿":
        after = KANA
    elif c.isupper():
        after = UPPER
    elif c.isdigit():
        after = DIGIT
    elif c.isalpha() and c.lower() == c.upper():
        after = CASELESS
    else:
        after = CAMEL if _CAMEL_WORD.match(text, b, b + 24) else ELSE
    return NUMBER_OF["joined", mark, _joined_flags(text, a, mark) if after not in (KANA, ELSE) else 0, after]


def _list_heads(text: str) -> tuple[set[int], set[int]]:
    """Line breaks before list items, and starts of item numbers.

    A bullet makes any line an item. A number does if its paragraph begins with one, or if it goes
    on counting from the item before; else it may be a date or figure wrapped to the line's start.
    """
    breaks, numbers = set(), set()
    if "\n" not in text:
        m = _ITEM.match(text)
        return breaks, {m.start(2)} if m and m.group(2) and text[:1].isdigit() else set()
    count, para = 0, True
    at = 0
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        if end - at < 200 and not text[at:end].strip() or _BLANKS.match(text, at, end).end() == end:
            count, para = 0, True
        else:
            m = _ITEM.match(text, at, end)
            if m and (m.group(1) and m.group(1) != "-" or m.group(1) == "-" or para or count and int(m.group(2)) == count + 1):
                breaks.add(at - 1)
                if m.group(2):
                    numbers.add(m.start(2))
                    count = int(m.group(2))
            para = False
        at = end + 1
    return breaks, numbers


# ---- the lexer ----------------------------------------------------------------------------------------------

_PARTNER = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", '"': '"'}


@dataclass
class Around:
    """What a stretch of text must know of the rest: list heads in it, and quotation marks before and behind it."""

    breaks: set[int] = field(default_factory=set)
    numbers: set[int] = field(default_factory=set)
    later: frozenset[str] = frozenset()  #: marks behind the stretch in the paragraph it ends in
    low_before: bool = False
    angle_before: bool = False
    straight_open: bool = True  #: no empty line stands between the last straight mark, or the beginning, and the stretch


def events(text: str, start: int, stop: int, around: Around) -> tuple[list[int], list[int]]:
    """Symbols of the events in ``text[start:stop]``, and for each the end of the unit that would end there.

    What stands outside the bounds is only looked at, never an event. Ends are positions after the
    last character that is not white space. Every character is visited a bounded number of times.
    """
    symbols: list[int] = []
    ends: list[int] = []
    place: dict[str, list[int]] | None = None
    empty: list[int] = []
    para_end, open_para = -1, False
    skip = start
    behind = start  # where the closing marks after the last quotation mark end
    solid, looked = start - 1, start  # last character before ``looked`` that is neither blank nor closing

    def told(symbol: int, end: int) -> None:
        while end > start and text[end - 1].isspace():
            end -= 1
        symbols.append(symbol)
        ends.append(end)

    for m in (_EVENT_WIDE if _WIDE.search(text) else _EVENT).finditer(text, start, stop):
        at, c = m.start(), m.group()
        if at < skip:
            continue
        if c == ".":
            nxt = text[at + 1 : at + 2]
            if "a" <= nxt <= "z" and not _CAMEL.match(text, at + 1) or nxt.isdigit() and text[at - 1 : at].isdigit():
                continue  # inside a name or number
        if c in _TERM:
            run = _MARKS_RUN.match(text, at)
            skip = run.end()
            symbol = _end_symbol(text, at, skip, around.numbers)
            if symbol != NONE:
                told(symbol, skip)
        elif c.isspace():
            para = _PARA.match(text, at) if c == "\n" else None
            if para:
                skip = para.end()
                told(RESET, at)
            elif c == "\n" and at in around.breaks:
                told(RESET, at)
            elif at and "ก" <= text[at - 1] <= "๎":
                after = _BLANKS.match(text, at).end()
                nxt = text[after : after + 1]
                tail = "." if "ก" <= nxt <= "๎" else _FOREIGN_END.match(text, after).group().rstrip().rstrip("”»\"")
                if nxt and tail[-1:] and tail[-1] in _TERM:
                    told(TERM, at)
        else:
            if place is None:
                place = {q: [] for q in _QUOTES}
                for q in _QUOTE.finditer(text, start, stop):
                    place[q.group()].append(q.start())
                empty = [e.start() for e in re.finditer("(?=\n\n)", text[start:stop])] if place['"'] else []
                empty = [start + e for e in empty]
            if para_end < at and not open_para:
                found = _PARA.search(text, at, stop)
                para_end, open_para = (found.start(), False) if found else (stop, True)

            def ahead(marks: str, at: int = at) -> bool:
                for q in marks:
                    k = bisect.bisect_right(place[q], at)
                    if k < len(place[q]) and place[q][k] < para_end or open_para and q in around.later:
                        return True
                return False

            def before(q: str, at: int = at) -> bool:
                return bool(place[q]) and place[q][0] < at

            mark = c
            if mark in "„«「『" and not ahead(_PARTNER[mark]):
                continue  # never closed in this paragraph
            if mark == "“" and not ahead("”") and not (around.low_before or before("„")):
                continue
            if mark == '"' and not ahead('"'):
                last, line = bisect.bisect_left(place['"'], at), bisect.bisect_right(empty, at - 2)
                if not (last and (not line or place['"'][last - 1] > empty[line - 1]) or not last and not line and around.straight_open):
                    continue  # neither closed in this paragraph nor opened after the last empty line
            if mark == "»" and (at == 0 or text[at - 1].isspace()) and text[at + 1 : at + 2].isalpha() and ahead("«") and not (around.angle_before or before("«")):
                mark = "»open"
            k = at - 1
            while k >= looked and (text[k].isspace() or text[k] in _CLOSE + "”»」』"):
                k -= 1
            solid, looked = k if k >= looked else solid, at
            end = text[solid] if solid >= 0 else ""
            left = OPEN_END if not end or end not in _TERM or end == ";" and not (solid and "Ͱ" <= text[solid - 1] <= "Ͽ") else WESTERN_END if end in ".!?…" else OTHER_END
            right = AFTER_ELSE
            if left != OPEN_END:
                behind = behind if behind > at else _BEHIND.match(text, at + 1).end()
                if behind >= len(text):
                    right = AFTER_START
                elif text[behind].isspace():
                    nxt = _BLANKS.match(text, behind).end()
                    right = AFTER_START if nxt >= len(text) or _starts(text, nxt) else AFTER_NO
                else:
                    right = AFTER_OPEN if text[behind] in "“„«「『" else AFTER_UPPER if text[behind].isupper() else AFTER_ELSE
            told(NUMBER_OF["quote", mark, left, right], at + 1)
    return symbols, ends


def whole(text: str) -> tuple[list[int], list[int]]:
    """Events of a whole text, its end included."""
    breaks, numbers = _list_heads(text) if "\n" in text or text[:1].isdigit() else (set(), set())
    symbols, ends = events(text, 0, len(text), Around(breaks, numbers))
    return [*symbols, RESET], [*ends, len(text.rstrip())]


def _risen(ends: list[int], flags: np.ndarray) -> list[int]:
    """Ends of units: each place once, and none before the first character."""
    found: list[int] = []
    for pos, flag in zip(ends, flags):
        if flag and pos > (found[-1] if found else 0):
            found.append(pos)
    return found


def unit_ends(texts: list[str | None]) -> list[list[int]]:
    """For each text, the number of characters up to the end of each unit. NULL and blank texts have none."""
    symbols: list[int] = []
    ends: list[list[int]] = []
    for t in texts:
        s, e = whole(t) if t and not t.isspace() else ([], [])
        symbols += s
        ends.append(e)
    said = run_transducer(np.asarray(symbols, dtype=np.int64))
    out, at = [], 0
    for e in ends:
        out.append(_risen(e, said[at : at + len(e)]))
        at += len(e)
    return out


# ---- long texts ---------------------------------------------------------------------------------------------

#: Characters from which a text is cut, length of a chunk, and how far its neighbours' text is shown to it.
LONG_TEXT = 1 << 20
CHUNK = 1 << 18
HALO = 64


def chunks(text: str, size: int = CHUNK) -> Iterator[dict]:
    """A long text in chunks with what each must know of the rest (see ``Around``).

    Cuts lie between two letters or digits (between two letters of Thai where there are any), so no
    run of marks or blanks is cut and ``HALO`` characters on both sides show all that a rule looks at.
    """
    pair = re.compile(rf"[{_THAI}]{{2}}" if re.search(f"[{_THAI}]", text) else r"[^\W_]{2}")
    cuts = [0]
    while (m := pair.search(text, cuts[-1] + size)) is not None:
        cuts.append(m.start() + 1)
    cuts.append(len(text))
    breaks, numbers = (sorted(x) for x in _list_heads(text))
    spans = list(zip(cuts, cuts[1:]))
    later: frozenset[str] = frozenset()
    behind = []
    for a, b in reversed(spans):  # what stands behind a chunk in its last paragraph, from the end
        behind.append(later)
        first = _PARA.search(text, a, b)
        here = frozenset(_QUOTE.findall(text, a, first.start() if first else b))
        later = here if first else here | later
    low = angle = False
    straight, line = -1, -1
    inside = lambda xs, a, b: xs[bisect.bisect_left(xs, a) : bisect.bisect_left(xs, b)]
    for k, ((a, b), after) in enumerate(zip(spans, reversed(behind))):
        left = max(0, a - HALO)
        yield {
            "chunk": k, "left": left, "start": a - left, "stop": b - left, "last": b == len(text), "body": text[left : b + HALO], "later": "".join(sorted(after)),
            "breaks": [x - left for x in inside(breaks, left, b)], "numbers": [x - left for x in inside(numbers, left, b)],
            "low": low, "angle": angle, "straight": straight >= line,
        }
        low, angle = low or "„" in text[a:b], angle or "«" in text[a:b]
        straight, line = max(straight, text.rfind('"', a, b)), max(line, text.rfind("\n\n", a, b))


def chunk_events(c) -> tuple[list[int], list[int]]:
    """Symbols and ends (from the text's beginning) of one of ``chunks``."""
    around = Around(set(c["breaks"]), set(c["numbers"]), frozenset(c["later"]), c["low"], c["angle"], c["straight"])
    symbols, ends = events(c["body"], c["start"], c["stop"], around)
    if c["last"]:
        symbols, ends = [*symbols, RESET], [*ends, len(c["body"][: c["stop"]].rstrip())]
    return symbols, [e + c["left"] for e in ends]


_CHUNK_TYPE = "chunk int, left bigint, start int, stop int, last boolean, body string, later string, breaks array<int>, numbers array<int>, low boolean, angle boolean, straight boolean"


def _long_ends(df: DataFrame, text: str, size: int) -> DataFrame:
    """``__u`` and ``end_pos`` of long texts, a chunk a row: events and transition functions, a prefix scan over the functions, outputs."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for u, t in zip(pdf["__u"], pdf[text]):
                for c in chunks(t, size):
                    yield pd.DataFrame([{"__u": u, **c}])

    rows = df.select("__u", text).mapInPandas(cut, f"__u bigint, {_CHUNK_TYPE}")
    rows = rows.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__u", "chunk")

    @F.pandas_udf("symbols array<int>, ends array<bigint>, f array<int>")
    def read(c: pd.DataFrame) -> pd.DataFrame:
        made = [chunk_events(row) for row in c.to_dict("records")]
        return pd.DataFrame({"symbols": [s for s, _ in made], "ends": [e for _, e in made], "f": [transition(np.asarray(s, dtype=np.int64)).tolist() for s, _ in made]})

    names = [x.split(" ")[0] for x in _CHUNK_TYPE.split(", ")]
    told = durable(rows.select("__u", "chunk", read(F.struct(*names)).alias("e")).select("__u", "chunk", "e.*"))

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        return pdf[["__u", "chunk"]].assign(state=entry_states(np.stack(pdf["f"].to_numpy())).astype(np.int32))

    states = told.select("__u", "chunk", "f").groupBy("__u").applyInPandas(scan, "__u bigint, chunk int, state int")

    @F.pandas_udf("array<bigint>")
    def emit(symbols: pd.Series, ends: pd.Series, state: pd.Series) -> pd.Series:
        return pd.Series([_risen(e, run_transducer(np.asarray(s, dtype=np.int64), state=k)) for s, e, k in zip(symbols, ends, state)])

    return told.join(states, ["__u", "chunk"]).select("__u", F.explode(emit("symbols", "ends", "state")).alias("end_pos"))


def sentence_ends(df: DataFrame, key: str, text: str = "text", long_text: int = LONG_TEXT, chunk: int = CHUNK) -> DataFrame:
    """``key`` and ``end_pos``, one row per sentence unit (see ``unit_ends``).

    Texts below ``long_text`` characters are read whole, without a shuffle. Longer ones are cut into
    chunks, rows of their own; the result is the same. NULL and blank texts have no unit; repeated
    keys are read each by itself.
    """

    @F.pandas_udf("array<bigint>")
    def ends(texts: pd.Series) -> pd.Series:
        return pd.Series(unit_ends([None if t is None or t != t else t for t in texts]))

    d = df.select(F.col(key), F.col(text).alias("__t"))
    is_long = F.char_length("__t") >= long_text
    short = d.select(key, F.explode(ends(F.when(~is_long, F.col("__t")))).alias("end_pos"))
    if not d.filter(is_long).limit(1).count():
        return short
    long = durable(d.filter(is_long).withColumn("__u", F.monotonically_increasing_id()))
    return short.unionByName(_long_ends(long, "__t", chunk).join(long.select(key, "__u"), "__u").select(key, "end_pos"))


def sentences(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key``, ``unit`` (from 1), ``end_pos`` and ``sentence`` (white space around it stripped)."""

    @F.pandas_udf("array<struct<unit:int,end_pos:bigint,sentence:string>>")
    def cut(texts: pd.Series) -> pd.Series:
        texts = [None if t is None or t != t else t for t in texts]
        return pd.Series([[{"unit": k + 1, "end_pos": b, "sentence": t[a:b].strip()} for k, (a, b) in enumerate(zip([0, *e], e))] for t, e in zip(texts, unit_ends(texts))])

    return df.select(F.col(key), F.inline(cut(F.col(text))))
