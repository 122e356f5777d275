"""Text that was decoded with the wrong character encoding: find it, restore what can be known.

For each encoding the text may have been read in, its characters are mapped back to bytes, one
byte a character (two for double-byte sets), with an impossible byte wherever a character has no
place in it. An automaton over byte structure then finds the maximal well-formed multibyte spans,
and only those spans are decoded; everything around them stays as it is.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Encodings in which UTF-8 text is commonly read by mistake; bytes they leave open read as C1 controls.
READ_AS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "koi8_r", "cp1253", "cp1257", "cp866", "cp874", "cp1256", "iso8859_2", "iso8859_15")
#: Of these, sets whose own language forms well-formed spans by chance: they must explain the whole value.
STRICT = ("cp866", "cp874", "cp1253", "cp1256", "cp1257", "iso8859_2")
#: Double-byte sets in which UTF-8 text is read by mistake.
READ_AS_WIDE = ("gb18030", "cp932")
#: Legacy encodings whose bytes are read as Western text, with the test their result must pass.
LEGACY = ("gbk", "euc_jp", "shift_jis", "big5", "euc_kr", "cp1251", "koi8_r", "iso8859_7", "cp1256", "tis_620")

# Letters of each script from the most to the least frequent in running text.
FREQUENT = {
    "cyrillic": "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё",
    "greek": "αοιτεςηνσρκπμυλάίγδόέωφθήχύβώξζψϊϋ",
    "arabic": "اليمنوترةهبدعسفكقحشأطجصخىءذإئضثزغؤظآ،؟",
    "thai": "าน่รอกเง้มยัลวดทีสตะปบคิหแจุชพูผข์ใโไซถำื็ฟศธณึฐๆฉภญษ",
}

_UTF8_SPAN = re.compile(
    rb"(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    rb"|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})+"
)
_LEGACY_SPAN = {
    "gbk": re.compile(rb"(?:[\x81-\xfe][\x40-\x7e\x80-\xfe])+"),
    "big5": re.compile(rb"(?:[\xa1-\xf9][\x40-\x7e\xa1-\xfe])+"),
    "euc_jp": re.compile(rb"(?:[\xa1-\xfe]{2}|\x8e[\xa1-\xdf]|\x8f[\xa1-\xfe]{2})+"),
    "euc_kr": re.compile(rb"(?:[\xa1-\xfe]{2})+"),
    "shift_jis": re.compile(rb"(?:[\x81-\x9f\xe0-\xef][\x40-\x7e\x80-\xfc]|[\xa1-\xdf])+"),
}
_HIGH_SPAN = re.compile(rb"[\x80-\xff]+(?:[ .,!?\-\"'()0-9%:]*[\x80-\xff]+)*")


@functools.cache
def byte_table(codec: str) -> dict[int, int]:
    """Code point to code point of its byte, for every character outside ASCII."""
    table: dict[int, int] = {}
    for b in range(128, 256):
        try:
            table[ord(bytes([b]).decode(codec))] = b
        except UnicodeDecodeError:
            table[b] = b
    if codec not in ("latin-1", "iso8859_2", "iso8859_15"):
        for b in range(0x80, 0xA0):  # sloppy readers pass unassigned bytes through
            table.setdefault(b, b)
    return table


@functools.cache
def _borrowed(codec: str) -> frozenset[str]:
    """Controls that stand for a byte the set has another character for: the set's readers do not leave them."""
    if codec in ("latin-1", "iso8859_2", "iso8859_15"):
        return frozenset()
    held = set()
    for b in range(0x80, 0xA0):
        try:
            bytes([b]).decode(codec)
            held.add(chr(b))
        except UnicodeDecodeError:
            pass
    return frozenset(held)


@functools.cache
def _pair(codec: str) -> re.Pattern:
    """A first and a following byte of a multibyte character, as readers of the set see them: what every span begins with."""
    by_byte = {b: chr(c) for c, b in byte_table(codec).items()}
    more = [chr(c) for c, b in byte_table(codec).items() if by_byte[b] != chr(c)]  # a control beside the byte's own character
    one = lambda a, z: "".join(re.escape(c) for c in [*(by_byte[b] for b in range(a, z) if b in by_byte), *(c for c in more if a <= byte_table(codec)[ord(c)] < z)])
    return re.compile(f"[{one(0xC2, 0xF5)}][{one(0x80, 0xC0)}]")


class _ToByte(dict):
    """For str.translate: the byte of a character, 0 where it has none."""

    def __init__(self, codec: str):
        super().__init__(byte_table(codec))

    def __missing__(self, key: int) -> int:
        self[key] = value = key if key < 128 else 0
        return value


@functools.cache
def _to_byte(codec: str) -> _ToByte:
    return _ToByte(codec)


@functools.lru_cache(maxsize=64)
def to_bytes(text: str, codec: str) -> bytes:
    """One byte a character; 0, which no well-formed span holds, where there is none."""
    return text.translate(_to_byte(codec)).encode("latin-1")


def _script(c: str) -> str:
    o = ord(c)
    if o < 0x250:
        return "latin"
    if o < 0x300:
        return "ipa"
    for top, name in ((0x370, "mark"), (0x400, "greek"), (0x530, "cyrillic"), (0x590, "armenian"), (0x600, "hebrew"), (0x700, "arabic"), (0x900, "rare"), (0x980, "devanagari"), (0xE00, "indic"), (0xE80, "thai"), (0x1E00, "rare"), (0x2000, "latin"), (0x2070, "punct"), (0x20A0, "rare"), (0x20D0, "punct"), (0x2600, "symbol"), (0x3000, "rare"), (0x3040, "cjkpunct"), (0x3100, "kana"), (0x3400, "rare"), (0x4E00, "rarehan"), (0xA000, "han"), (0xAC00, "rare"), (0xD7B0, "hangul"), (0xF900, "rare"), (0xFF00, "rare"), (0xFFF0, "cjkpunct")):
        if o < top:
            return name
    return "rare" if o < 0x1F000 or o > 0x1FAFF else "symbol"


_LIKELY_SINGLE = re.compile("[\u0080-\u00ffĄ-ćČ-đĘ-ěİıŁ-ńŇňŐ-œŘ-šŤťŮ-űŸ-žƒˆ˜‐-›€№™−]")


#: Three characters that sound text sets just so: a letter, then closing marks or fixed spaces.
_TYPOGRAPHIC = re.compile("[^\\W\\d_][\u00a0\u202f…”’»«–—]{2}")
#: What a sound word does not hold: a capital after a small letter, box drawing, marks that stand inside no word, controls.
_BROKEN_WORD = re.compile("[а-яёα-ω][А-ЯЁΑ-Ω]|[\x80-\x9f─-▟‚ƒ„†‡ˆ‰‹€™¤¦¨¬±¶]|^Ё[А-Я]{3}$")


@functools.cache
def _assigned(c: str) -> bool:
    return unicodedata.category(c) not in ("Cn", "Co", "Cs", "Cc")


def certain(decoded: str, original: str, codec: str) -> bool:
    """Whether a span is well-formed by more than chance.

    It holds a character of three or four bytes, all its characters are assigned, and those read for
    them are no usual typography nor controls the set's readers do not leave; in a set of ``STRICT``
    they also form no sound word.
    """
    if max(decoded) < "\u0800" or not all(map(_assigned, decoded)) or _TYPOGRAPHIC.fullmatch(original):
        return False
    return _borrowed(codec).isdisjoint(original) and (codec not in STRICT or bool(_BROKEN_WORD.search(original)))


def plausible(decoded: str, alone: bool) -> bool:
    """Whether a decoded span reads as text: no rare blocks, no controls; a single letter must be a usual one."""
    if alone and len(decoded) == 1:
        return bool(_LIKELY_SINGLE.match(decoded)) or _script(decoded) in ("cjkpunct", "han", "kana", "thai", "devanagari")
    if all(c <= "\u00ff" or c in "ŒœŠšŸŽžƒˆ˜–—‘’‚“”„†‡•…‰‹›€™" for c in decoded):
        return True  # possibly one more layer
    if not all(c < "\u0100" or _assigned(c) for c in decoded):
        return False
    bad = sum(_script(c) in ("rare", "ipa", "rarehan", "mark") or "\x80" <= c <= "\x9f" for c in decoded)
    return bad * 5 <= len(decoded)


def _accepted(decoded: str, original: str, codec: str) -> bool:
    """``certain``, or ``plausible`` and no usual typography."""
    return certain(decoded, original, codec) or plausible(decoded, True) and not _TYPOGRAPHIC.fullmatch(original)


_NEUTRAL = set("“”„‘’‚–—…«»€·•\u00a0¿¡°±§")


def utf8_spans(text: str, codec: str) -> tuple[float, list[tuple[int, int, str]]]:
    """Maximal spans that are well-formed multibyte UTF-8 once mapped back through ``codec``.

    Also the share of the characters that they explain: of the unbroken runs of such characters
    they lie in, or of the whole value for sets of ``STRICT``; neutral punctuation is left out.
    """
    if not _pair(codec).search(text):
        return 0.0, []
    raw = to_bytes(text, codec)
    if not _UTF8_SPAN.search(raw):
        return 0.0, []
    spans, covered, all_high, scripts = [], 0, 0, set()
    for m in _UTF8_SPAN.finditer(raw):
        decoded = m.group().decode("utf-8")
        if len(decoded) > 1 and plausible(decoded, True):
            scripts.update(map(_script, decoded))
    for run in re.finditer(r"[^\x00-\x7f]+", text):
        took = []
        for m in _UTF8_SPAN.finditer(raw, run.start(), run.end()):
            decoded = m.group().decode("utf-8")
            kind, original = _script(decoded[0]), text[m.start() : m.end()]
            beside = {_script(c) for c in text[max(0, m.start() - 1) : m.start()] + text[m.end() : m.end() + 1] if c.isalpha()}
            if _accepted(decoded, original, codec) or not _TYPOGRAPHIC.fullmatch(original) and kind != "rare" and all(map(_assigned, decoded)) and (kind in scripts or kind in beside and kind not in ("latin", "ipa")):
                took.append((m.start(), m.end(), decoded))
        if took or codec in STRICT:
            spans += took
            left = set(range(run.start(), run.end())).difference(*[range(a, b) for a, b, _ in took])
            covered += sum(b - a for a, b, _ in took)
            all_high += sum(text[k] not in _NEUTRAL and bool(raw[k] or _script(text[k]) in ("latin", "symbol", "mark")) for k in left)
    return (covered / (covered + all_high) if covered else 0.0), spans


_WIDE_RUN = re.compile(r"[^\x00-\x7f�-]+")
#: Stretches that may lie inside a run: characters of three bytes, or of two bytes of a script that is not Latin.
_INNER_SPAN = re.compile(
    rb"(?:\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf])(?:(?:\xc2[\xa0-\xbf])?(?:\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]))+"
    rb"|(?:[\xcd-\xd3\xd8-\xdb][\x80-\xbf]){4,}"
)
_MARKS = {"punct", "cjkpunct"}


def _sure(decoded: str) -> bool:
    """Whether a stretch inside a run reads as text too well for sound text to form it by chance: usual ideographs or kana, or some letters of one script."""
    kinds = {_script(c) for c in decoded}
    letters = [c for c in decoded if _script(c) not in _MARKS and ord(c) > 0xFF]
    if kinds & {"rare", "rarehan", "ipa", "mark", "armenian", "hebrew", "symbol"} or len(letters) < 2:
        return False
    if kinds <= {"han", "kana", "hangul", "latin"} | _MARKS:
        return max(_wide_quality("".join(letters), codec) for codec in ("gbk", "big5", "shift_jis", "euc_kr")) >= 0.5
    return len(kinds - _MARKS) == 1 and len(letters) >= (3 if letters[0] >= "\u0800" else 4)


def _lost(raw: bytes) -> str:
    """What is left of bytes beside a span: ASCII that a pair took in, and a mark for every byte that cannot be known."""
    return "".join(chr(b) if b < 0x80 else "�" for b in raw)


def _inner_spans(run: str, codec: str, after_loss: bool) -> list[tuple[int, int, str]]:
    """Well-formed stretches anywhere in a run, with the positions of the characters they touch.

    Sound text beside a stretch was read apart from it, so a stretch begins with a character, except
    after a lost byte: where the run follows a replacement character, or within three bytes of the stretch before.
    """
    parts = []
    for c in run:
        try:
            parts.append(c.encode(codec))
        except UnicodeEncodeError:
            parts.append(b"\0")
    raw = b"".join(parts)
    starts, owner = {0: 0}, []
    for k, x in enumerate(parts):
        owner += [k] * len(x)
        starts[len(owner)] = k + 1
    made: list[list] = []  # first and last byte of each stretch and its text
    for m in _INNER_SPAN.finditer(raw):
        (a, b), decoded = m.span(), m.group().decode("utf-8")
        near = made and a - made[-1][1] <= 3 or not made and after_loss and a <= 3 and all(0x80 <= x < 0xC0 for x in raw[:a])
        while decoded and a not in starts and not near:  # its first bytes end a sound character
            a, decoded = a + len(decoded[0].encode()), decoded[1:]
        if decoded and _sure(decoded):
            made.append([a, b, decoded])
    spans: list[list] = []
    for a, b, decoded in made:
        first, last = owner[a], owner[b - 1]
        if spans and (first <= spans[-1][1] - 1 or a - spans[-1][3] <= 3):
            spans[-1][1:] = [last + 1, spans[-1][2] + _lost(raw[spans[-1][3] : a]) + decoded, b]
        else:
            if not spans and after_loss and a <= 3:
                first = 0
            spans.append([first, last + 1, _lost(raw[owner.index(first) : a]) + decoded, b])
    return [(first, end, text + _lost(raw[b : owner.index(end) if end < len(run) else len(raw)])) for first, end, text, b in spans]


def wide_spans(text: str, codec: str) -> list[tuple[int, int, str]]:
    """The same for double-byte sets: runs outside ASCII are encoded and cut at ill-formed bytes.

    UTF-8 read in a double-byte set eats ASCII into pairs, so a run may take up to one following
    byte; the replacement character stands for one lost byte and ends a span. A run that is one
    stretch from its head is taken whole; of any other, the stretches that are ``_sure``.
    """
    spans = []
    for m in _WIDE_RUN.finditer(text):
        raw = m.group().encode(codec, "replace")
        good = _UTF8_SPAN.match(raw)
        if good and len(raw) - good.end() <= 2 and b"?" not in raw[: good.end()]:
            decoded, lost = good.group().decode("utf-8"), raw[good.end() :]
            if b"?" not in lost and plausible(decoded, True):
                tail = ""
                if lost:
                    if lost[-1] < 0x80:
                        tail = chr(lost[-1])
                    tail = "�" * (len(lost) - len(tail)) + tail
                spans.append((m.start(), m.end(), decoded + tail))
                continue
        if _INNER_SPAN.search(raw):
            spans += [(m.start() + a, m.start() + b, decoded) for a, b, decoded in _inner_spans(m.group(), codec, text[m.start() - 1 : m.start()] == "�")]
    return spans


def _frequency(text: str, script: str) -> float:
    """Mean commonness (0..1) of the letters of ``text`` outside ASCII in a script; other letters count against it."""
    weights = _weights(script)
    scores = [weights.get(c.lower(), -0.5) for c in text if c > "\x7f" and not c.isspace()]
    return sum(scores) / max(1, len(scores))


@functools.cache
def _weights(script: str) -> dict[str, float]:
    """Commonness of every letter of a script."""
    order = FREQUENT[script]
    return {c: 1 - k / len(order) for k, c in reversed(list(enumerate(order)))}


def _case_breaks(text: str) -> float:
    """Share of letters whose case breaks the word (upper case after lower case, or a tail of capitals after a small head)."""
    words = re.findall(r"[^\W\d_]{2,}", text)
    letters = sum(map(len, words))
    return sum(len(w) for w in words if not (w.islower() or w.isupper() or w[0].isupper() and w[1:].islower())) / max(1, letters)


def _wide_quality(decoded: str, codec: str) -> float:
    good = 0.0
    for c in decoded:
        s = _script(c)
        if s == "han":
            try:
                raw = c.encode("gb2312" if codec == "gbk" else codec)
                low, high = {"gbk": (0xB0, 0xD7), "euc_jp": (0xB0, 0xCF), "shift_jis": (0x88, 0x97), "big5": (0xA4, 0xC6), "euc_kr": (0, 0)}[codec]
                good += 0.9 if low <= raw[0] <= high else -0.6
            except UnicodeEncodeError:
                good -= 0.8
        elif s == "kana":
            good += 1.0 if codec in ("euc_jp", "shift_jis") else -0.5
        elif s == "hangul":
            good += 0.8 if codec == "euc_kr" else -1
        elif s in ("cjkpunct", "punct"):
            good += 0.6
        elif "｡" <= c <= "ﾟ":
            good -= 0.6
        elif s == "latin":
            good += 0.4
        else:
            good -= 0.4
    return good / max(1, len(decoded))


def legacy_spans(text: str, codec: str, read_as: str = "cp1252") -> tuple[float, list[tuple[int, int, str]]]:
    """Spans of legacy bytes that were read as single-byte text, and how well their decoding reads (0..1)."""
    raw = to_bytes(text, read_as)
    wide = codec in _LEGACY_SPAN
    spans, total, chars = [], 0.0, 0
    for m in (_LEGACY_SPAN[codec] if wide else _HIGH_SPAN).finditer(raw):
        try:
            decoded = m.group().decode("cp932" if codec == "shift_jis" else codec)
        except UnicodeDecodeError:
            if not wide:
                return 0.0, []
            total, chars = total - len(m.group()), chars + len(m.group())
            continue
        if wide:
            q = _wide_quality(decoded, codec)
            if q < 0.3 and len(decoded) < 3:
                continue
        elif sum(b > 127 for b in m.group()) < 3:
            continue
        else:
            script = {"cp1251": "cyrillic", "koi8_r": "cyrillic", "cp866": "cyrillic", "iso8859_7": "greek", "cp1256": "arabic", "tis_620": "thai"}[codec]
            q = _frequency(decoded, script) - _case_breaks(decoded)
        spans.append((m.start(), m.end(), decoded))
        total, chars = total + q * len(m.group()), chars + len(m.group())
    return (total / chars if chars >= 4 else 0.0), spans


# Runs that no Western text holds: three or more upper Latin-1 characters in a row of which one is
# no letter, or words of them alone; pairs as left by two-byte sets.
_WESTERN_HIGH = "\u0080-ÿŒœŠšŸŽžƒˆ˜–-•…‰‹›€™"
_HIGH_RUN = re.compile(f"[{_WESTERN_HIGH}]{{3,}}")
_LETTER_RUN = re.compile("[À-ÖØ-öø-ÿ]{4,}|(?<![^\\W\\d_])[À-ÖØ-öø-ÿ]{3,}(?![^\\W\\d_])")
_ODD = re.compile("[¤¦¨¬¯´¶¸ƒˆ˜]")
_SJIS_HEAD = re.compile("[‚ƒ\u0081-\u009f]")


def _apply(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, decoded in spans:
        out += [text[at:a], decoded]
        at = b
    return "".join([*out, text[at:]])


#: Cheap first look: what sound text of any of the scripts rarely holds.
_W = "À-ÿĀ-ſƒˆ˜–—‘’‚“”„†‡•…‰‹›€™"
_SUSPECT = re.compile(
    "[\x80-\x9f�─-▟∂∏∑√∞∫≈≠≤≥◊⌐ﬁﬂ¤¦¨¬¯´¶¸ªƒˆˇ˜˘˙˚˝˛‡†‰‚ÿìòÈÒÛÙÎÏËÌ]"
    f"|[{_W}][¡-¿{_W}]|[a-z][À-ÖØ-Þ„¡-ª¬-º¼-¿Ѐ-ӿͰ-Ͽ]|[Ѐ-ӿͰ-Ͽ][a-zÀ-ÿ]|(?:^| )[ìíîóÖñòÄ](?: |\\d|$)|–[A-Za-z]|[A-Za-z]–|[A-Za-z][“”][a-z]"
    "|[ЂЃѓЉЊЌЋЏђљњќћџЎўЈҐЄЇІіґєјЅѕї]|[Ѐ-ӿ][¡-ª¬-º¼-¿]|[а-яё][А-ЯЁ]|[А-ЯЁ]{3}|[¡-¿ÃÂÐÑØÙàãåäèéæçÎÏ][\u00a0-¿]"
)
_WIDE_SUSPECT = re.compile("[一-鿿｡-ﾟ]")


#: A no-break space that lost its second byte's look on the way, and a text cut inside a damaged letter.
_FLATTENED = re.compile("(?<=[0-9a-zà-ÿ])Â (?=[%:;!?»€])")
_CUT_SHORT = re.compile("(?:(?<=[a-z])|(?<=[\\s“(]))Ã$|â€$")


def repair(text: str | None) -> tuple[str | None, str | None]:
    """``(restored text, kind)``; kind is None for sound text.

    kind ``restored``: every damaged span was decoded; ``partial``: something stays lost;
    ``lost``: damage was seen, but nothing could be decoded. NULL and empty texts are sound.
    Double damage is undone layer by layer.
    """
    if not text or text.isascii() or not (_SUSPECT.search(text) or any(_pair(codec).search(text) for codec in READ_AS) or _FLATTENED.search(text) or _CUT_SHORT.search(text) or _WIDE_SUSPECT.search(text) and any(_wide_is_damage(text, x) for codec in READ_AS_WIDE for x in wide_spans(text, codec))):
        return text, None
    text = _FLATTENED.sub("Â\u00a0", text)
    current, touched = text, False
    legacy: tuple[float, str] | None = None
    for layer in range(4):
        best: tuple[float, list] = (0.0, [])
        whole = False
        foreign = sum(c > "\x7f" and c not in _NEUTRAL for c in current)
        for codec in READ_AS:
            share, spans = utf8_spans(current, codec)
            if spans and share >= (0.9 if codec in STRICT else 0.6) and not (codec in STRICT and len(spans) < 2 and not certain(spans[0][2], current[spans[0][0] : spans[0][1]], codec)):
                length = sum(b - a for a, b, _ in spans)
                gain = length * share - 0.25 * sum(current[k] in _borrowed(codec) for a, b, _ in spans for k in range(a, b))
                if gain > best[0]:
                    best, whole = (gain, spans), share > 0.95 and length >= 0.95 * foreign
        if not whole:  # a reading that explains the whole value stands, whatever the others give
            for codec in READ_AS_WIDE:
                spans = [s for s in wide_spans(current, codec) if _wide_is_damage(current, s)]
                gain = sum(2 * (b - a) for a, b, _ in spans)
                if gain > best[0]:
                    best = (gain, spans)
            if not layer:
                legacy = _legacy_repair(text)
                if legacy and legacy[0] > best[0]:
                    break
                legacy = None if best[1] else legacy
        if not best[1]:
            break
        current, touched, legacy = _apply(current, best[1]), True, None
    if legacy:
        current, touched = legacy[1], True
    if not touched and "�" not in current:
        swapped = _swap_repair(current)
        if swapped is not None:
            current, touched = swapped, True
    if "�" in current or _still_damaged(current) or touched and _certain_left(current):
        return current, "partial" if touched else "lost"
    return current, "restored" if touched else None


#: (read as, written in) of Western text that one single-byte set wrote and another read.
SWAPS = (("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1250", "cp1252"), ("cp1251", "cp1252"), ("koi8_r", "cp1252"), ("cp1253", "cp1252"), ("cp1257", "cp1252"))

# How usual the letters beyond ASCII are in Western text, from common to rare.
_COMMON = set("éáíóúñüöäßàèçãõâêôïëœûåøæùł")
_INITIALS = set("ÉÖÜÄÀÇÂÓÁÑØÅÐŁÊ")
_WORDS_OF_ONE = set("éàÉÀêÁáÀ")
_SPACE = " \u00a0\u2009\u202f\t\n"


_EASTERN = {"han", "kana", "cjkpunct"}


def western_cost(text: str) -> float:
    """How oddly the characters beyond ASCII stand in Western text; 0 is usual, a clear oddity 1 to 2."""
    cost = 0.0
    for m in re.finditer("[^\u0000-\u007f]", text):
        c, k = m.group(), m.start()
        a, b = text[k - 1] if k else " ", text[k + 1] if k + 1 < len(text) else " "
        if c in "\u00a0\u2009\u3000\u202f¿¡" or c in "“”‘’…—–·„«»" and ({_script(a), _script(b)} & _EASTERN or c in (a, b)):
            continue
        if "\x80" <= c <= "\x9f":
            cost += 3
        elif c in "“„«‹‘":
            cost += 0.1 if (a in _SPACE + "([{“„«‘'\"|-—–*" and b not in _SPACE) or c == "«" or (c == "“" and not a.isalnum()) or (c == "“" and b in _SPACE + ".,;:!?)") else 1.5
        elif c in "”»›":
            cost += 0.1 if not (b.isalnum() and b.isascii() and a.isalnum()) or c == "»" else 1.5
        elif c == "’":
            cost += 0.1 if a not in _SPACE or b.isalnum() else 1
        elif c == "‚":
            cost += 1.5
        elif c in "–—":
            cost += 0.1 if (a in _SPACE) == (b in _SPACE) and not (a.isalpha() and b.isalpha()) else 1.5
        elif c == "…":
            cost += 0.1 if a not in _SPACE and not b.isalpha() else 0.3 if b in _SPACE else 1.5
        elif c in "€£":
            cost += 0.1 if b.isdigit() or a.isdigit() or a in _SPACE + "Mm(" else 1.5
        elif c == "±":
            cost += 0.1
        elif _script(c) == "latin" and c.isalpha():
            if c.isupper():
                caps = a.isupper() or b.isupper()
                cost += 2 if a.islower() else 1.2 if b.isdigit() or a.isupper() and b.islower() else 0.1 if caps and c in _INITIALS | set("ÃÕÍÚÔÎÈ") else 0.2 if c in _INITIALS and b not in _SPACE or c in _WORDS_OF_ONE else 1.2
            elif a in _SPACE and b in _SPACE or b.isdigit():
                cost += 0.1 if c in _WORDS_OF_ONE else 1.2
            else:
                cost += 0.1 if c in _COMMON else 0.2 if c in "îð" and a.isalpha() and b.isalpha() or c == "ð" else 1.2
        elif c.isalpha():
            cost += 2 * (a.isascii() and a.isalpha() or b.isascii() and b.isalpha()) * (_script(c) in ("greek", "cyrillic")) + 1.5 * (_script(c) == "ipa")
        elif _script(c) in ("cjkpunct", "thai", "devanagari", "arabic"):
            continue
        else:
            cost += 0.2 if c in "°№·§" and not (a.isascii() and a.isalpha()) else 1.5
    return cost


def _swap_repair(text: str) -> str | None:
    """The text as another Western set reads it, if that clears the oddities."""
    now = western_cost(text)
    if now < 1 or _certain_left(text):
        return None
    best, made = now - 0.9, None
    for read_as, codec in SWAPS:
        raw = to_bytes(text, read_as)
        if any(not b and c.isalpha() for c, b in zip(text, raw)):
            continue  # a letter the set does not have: the value was not read in it
        out = "".join(c if c < "\x80" or not b else bytes([b]).decode(codec, "replace") for c, b in zip(text, raw))
        if "\ufffd" in out or out == text:
            continue
        cost = western_cost(out)
        if cost < best:
            best, made = cost, out
    return made


def _wide_is_damage(text: str, span: tuple[int, int, str]) -> bool:
    """A double-byte reading is damage if a byte is lost after it, if it is long, or if it gives the Latin letter its word lacks."""
    a, b, decoded = span
    before, after = text[a - 1 : a], text[b : b + 1]
    if after == "�" or _sure(decoded.replace("�", "")):
        return True
    if b - a >= 3 and all(_script(c) not in ("rare", "latin") or c in " «»" for c in decoded):
        return True
    latin = all(_script(c) in ("latin", "punct") for c in decoded)
    if not latin:
        return False
    if decoded[0].isalpha() or decoded[-1].isalpha():
        return after.islower() and after.isascii() or before.islower() and before.isascii() and not after.isalnum()
    eastern = sum(_script(c) in ("han", "kana") for c in text) - (b - a)
    return eastern * 5 < sum(c.isascii() and c.isalpha() for c in text) and (before + after).isascii()


def _legacy_repair(text: str) -> tuple[float, str] | None:
    """The best reading of the text as legacy bytes: characters it explains, and the result."""
    candidates = []
    if _HIGH_RUN.search(text) or _LETTER_RUN.search(text) or _SJIS_HEAD.search(text):
        sets = ("cp1252", "latin-1") if to_bytes(text, "cp1252") != to_bytes(text, "latin-1") else ("cp1252",)
        for codec in LEGACY:
            for read_as in sets:
                quality, spans = legacy_spans(text, codec, read_as)
                if spans and quality > 0.45:
                    candidates.append((quality * sum(b - a for a, b, _ in spans), _apply(text, spans)))
    if re.search("[Ѐ-ӿ]{2}", text):
        now = _frequency("".join(re.findall("[Ѐ-ӿ]", text)), "cyrillic") - _case_breaks("".join(re.findall("[Ѐ-ӿ\\s]", text)))
        for read_as, codec in (("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp866", "cp1251"), ("cp1251", "cp866")):
            quality, spans = legacy_spans(text, codec, read_as)
            if spans and quality > max(0.6, now + 0.1):
                candidates.append((quality * sum(b - a for a, b, _ in spans), _apply(text, spans)))
    return max(candidates) if candidates else None


def _certain_left(text: str) -> bool:
    """Whether a span that is ``certain`` in any of the sets stands in the text."""
    return any(certain(m.group().decode("utf-8"), text[m.start() : m.end()], codec) for codec in READ_AS if _pair(codec).search(text) for m in _UTF8_SPAN.finditer(to_bytes(text, codec)))


def _still_damaged(text: str) -> bool:
    for m in _HIGH_RUN.finditer(text):
        if any("\x80" <= c <= "\x9f" for c in m.group()) or len(_ODD.findall(m.group())) > 1:
            return True
    return bool(_CUT_SHORT.search(text)) or any("\x80" <= c <= "\x9f" for c in text) or bool(re.search("[─-▟]", text)) or bool(_LETTER_RUN.search(text) and not re.search("[A-Za-z]", text))


#: Values come again in other rows; a worker keeps the results of the last ones of usual length.
_kept = functools.lru_cache(maxsize=1 << 15)(repair)


def _seen(text: str | None) -> tuple[str | None, str | None]:
    return _kept(text) if text is None or len(text) <= 512 else repair(text)


def repair_values(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """The damaged values of ``fields``: ``key``, ``field``, ``value``, ``restored`` and ``kind``.

    kind is ``restored`` (all damage undone), ``partial`` or ``lost`` (see ``repair``); sound, NULL
    and empty values give no row. Values in plain ASCII cannot be damaged by a wrong encoding that
    keeps ASCII and are set aside in the JVM, before any text reaches Python. Narrow: no shuffle.
    """

    @F.pandas_udf("restored string, kind string")
    def judge(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_seen(v) for v in values], columns=["restored", "kind"])

    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))
    d = df.select(F.col(key), pairs.alias("__p")).select(key, "__p.field", "__p.value").filter(F.octet_length("value") > F.char_length("value"))
    d = d.withColumn("__r", judge("value")).filter(F.col("__r.kind").isNotNull())
    return d.select(key, "field", "value", F.col("__r.restored").alias("restored"), F.col("__r.kind").alias("kind"))
