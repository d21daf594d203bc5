"""Counts over texts from which document statistics are derived, for many texts at once.

Texts lie one after the other in one array of code points; classes of characters,
words, line breaks and stretches of running text are found by array operations
over all of them. What is said of a character depends on at most ``BEFORE``
characters before it and ``AFTER`` after it, so a piece of a text that brings these
along counts exactly what the whole text would count there. Only stretches (see
:data:`STRETCH`) have no bound: what a piece holds of the stretches at its two ends
is given as sums, which add up over pieces.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np

#: Frequent function words of six languages: the share of common words is counted with them.
COMMON = frozenset(
    """
    the a an and or but of to in on for with at from by as that this it its i my me we our you your he she they is are was were be been has
    have had not no so if do does did will would can could just than too there here what which who when how all any some more very only still
    der die das ein eine einen einem einer und oder aber nicht ist sind war ich es er sie wir mit auf für von zu den dem im am nach noch auch
    sich so schon hat habe bei aus man kann wie mehr mir mich sehr nur als wenn dass wird
    le la les un une des du de et ou mais pas ne est sont je il elle nous on ce se dans pour avec sur au aux que qui plus mon ma cela très
    sans été ai sa son leur si comme tout
    el los las una y o pero es son yo lo se en por con para del al me mi más muy su como ya hay está esta este sin fue
    gli i uno e non è sono io si di da per della che più ci ho ha come mio questo questa anche molto sta
    het een van maar niet zijn ik hij ze wij op voor te met om er aan dat die nog ook naar toen heb deze dit bij zeer wat
    """.split()
)

#: Characters before and after a piece on which the counts in it may depend.
BEFORE, AFTER = 1664, 1152
#: Longest line, in characters, and lines on either side, that tell whether a line break only wraps.
LINE_CHARS, LINES_NEAR = 512, 12
#: Characters of a script without spaces that make about one word.
UNSPACED_WORD = 2.2
#: A run of so many characters without a space is glued; so many of them pass for one odd word.
GLUED, GLUED_WORD = 46, 6
#: Characters of a word that tell it from others.
WORD_CHARS = 64
#: Words of a short and of a long shingle, and the span in characters beyond which words are none.
SHINGLES, SHINGLE_CHARS = (5, 20), 512

SPACE, NEWLINE, LETTER, MARK, UPPER, LOWER, LATIN, VOWEL, DIGIT, UNSPACED, KANA, ENDER, WIDE_ENDER, COMMA, CELL, BULLET, CLOSER, JOINER, KATAKANA = (1 << i for i in range(19))

_ENDERS = ".!?…‽؟۔।॥։።፧᠃။"
_WIDE_ENDERS = "。！？｡．"
_COMMAS = ",:;、，：；،؛"
_CELLS = "|\t•·▪✓✗✔✘#{}<>=│"
_BULLETS = "-+*•·▪◦‣✓✗✔✘>#–—"
_CLOSERS = "\"'”’»)]）」』*_~​"
_JOINERS = " '’-"
_VOWELS = "aeiouy"
#: Ranges of scripts that are written without spaces: Han, kana, Thai, Lao, Myanmar, Khmer.
_UNSPACED = ((0x3005, 0x3007), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x2FFFF), (0x0E01, 0x0E4E), (0x0E81, 0x0ECD), (0x1000, 0x109F), (0x1780, 0x17DD))
_TOP = 0x32000


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: flags of its class, and a random number of its lower-case form."""
    flags, low = np.zeros(_TOP, np.uint32), np.arange(_TOP, dtype=np.uint32)
    for i in range(_TOP):
        ch = chr(i)
        kind = unicodedata.category(ch)
        f = 0
        if ch.isspace():
            f |= SPACE
        elif kind[0] == "L":
            f |= LETTER
            if kind == "Lu" or kind == "Lt":
                f |= UPPER
                low[i] = ord(ch.lower()[0])
            elif kind == "Ll":
                f |= LOWER
            name = unicodedata.name(ch, "") if i < 0x2000 else ""
            if name.startswith("LATIN") or 0xFF21 <= i <= 0xFF5A:
                f |= LATIN
                if unicodedata.normalize("NFKD", ch.lower())[0] in _VOWELS or ch.lower() in "æœøı":
                    f |= VOWEL
        elif kind[0] == "M" or i in (0x200C, 0x200D):
            f |= MARK
        elif kind == "Nd":
            f |= DIGIT
        flags[i] = f
    flags[ord("\n")] |= NEWLINE
    for text, bit in ((_ENDERS, ENDER), (_WIDE_ENDERS, WIDE_ENDER), (_COMMAS, COMMA), (_CELLS, CELL), (_BULLETS, BULLET), (_CLOSERS, CLOSER), (_JOINERS, JOINER)):
        for ch in text:
            flags[ord(ch)] |= bit
    for a, b in _UNSPACED:
        part = flags[a : min(b + 1, _TOP)]
        part[(part & (LETTER | MARK)) != 0] |= UNSPACED
    flags[0x3041:0x3097] |= KANA
    flags[0x30A0:0x3100] |= KATAKANA
    flags[0xFF66:0xFFA0] |= KATAKANA
    z = (low.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return flags, z ^ (z >> np.uint64(31))


_POWERS = np.cumprod(np.full(WORD_CHARS, 0xD1342543DE82EF95, np.uint64))


@lru_cache(maxsize=1)
def _common_hashes() -> np.ndarray:
    _, mix = tables()
    return np.sort(np.array([(mix[[ord(x) for x in w]] * _POWERS[: len(w)]).sum() for w in COMMON], np.uint64))


#: Names of the counts, in order; all add up over a text's pieces.
PLAIN = (
    "n_chars", "n_spaces", "n_letters", "n_digits", "n_symbols", "n_words", "n_word_chars", "n_unspaced", "n_common", "n_odd", "n_lines",
    "n_end_lines", "n_bullet_lines", "n_latin", "n_vowels", "n_turns", "n_pairs", "n_triples", "n_echoes", "n_joins", "n_last_enders", "n_glued", "n_shingles",
    "n_distinct_shingles", "n_runs", "n_distinct_runs",
)
#: What a stretch of text is judged by: sums over its characters and words. A stretch ends with a sentence,
#: a line that is not only wrapped, a list item, a cell of a table, or the text.
STRETCH = ("words", "evidence", "common", "odd", "commas", "marks", "closed", "upper", "vowels", "latin", "unspaced")
#: What stretches amount to, summed over a text's.
JUDGED = ("n_units", "unit_words", "evidence", "closed_words", "marked_words", "open_35", "open_45", "open_75", "salad_words", "n_open", "open_words")
COUNTS = PLAIN + JUDGED
#: Where the counts stand that pieces don't add up to.
DISTINCT = [PLAIN.index("n_distinct_shingles"), PLAIN.index("n_distinct_runs")]

#: Least words of a sentence that ends as one, of one in a script or case that shows its begin, of a line
#: that nothing ends, alone and among others, and of an item or a cell.
UNIT_WORDS, BEGUN_WORDS, LINE_WORDS, ITEM_WORDS = 3.5, 1.9, 4.5, 7.5
#: Mean words of a line below which several lines that nothing ends are a list, as they are
#: where so large a share of a text is items and cells.
LINE_MEAN, MARKED_SHARE = 6.2, 0.25
#: Least share of words that show a text to be running text, greatest of odd words, of function words.
EVIDENCE, ODD_SHARE, SALAD_SHARE, SALAD_WORDS = 0.08, 0.34, 0.88, 8
#: Shares of vowels between which Latin letters can be said.
VOWELS_LEAST, VOWELS_MOST = 0.26, 0.68
#: Share of neighbouring Latin letters of which one is a vowel and the other is not, below which nobody can say them.
TURNS = 0.54


def judge(v: Sequence, pick) -> list:
    """JUDGED of stretches out of STRETCH. The values may be arrays or columns; ``pick(test, value)`` is the value or 0."""
    words, evidence, common, odd, commas, marks, closed, upper, vowels, latin, unspaced = v
    salad = (words >= SALAD_WORDS) & (common > SALAD_SHARE * words) & (unspaced == 0)
    said = (latin < 8) | ((vowels >= VOWELS_LEAST * latin) & (vowels <= VOWELS_MOST * latin))
    chopped = (commas >= 3) & (words < 2.6 * (commas + 1))
    ended, marked, begun = closed > 0, marks > 0, (upper > 0) | (latin == 0)
    shown = (evidence >= EVIDENCE * words) | (ended & (upper > 0))
    fine = shown & said & (odd <= ODD_SHARE * words) & ~chopped & ~salad
    whole = fine & ended & ((~marked & ((words >= UNIT_WORDS) | (begun & (words >= BEGUN_WORDS)))) | (marked & (words >= ITEM_WORDS)))
    is_open = ~ended & ~marked & (words > 0)
    line = fine & is_open
    one = words * 0 + 1
    return [
        pick(words > 0, one), words, evidence, pick(whole, words), pick(marked, words), pick(line & (words >= UNIT_WORDS), words), pick(line & (words >= LINE_WORDS), words),
        pick(line & (words >= ITEM_WORDS), words), pick(salad, words), pick(is_open, one), pick(is_open, words),
    ]


def pick_array(test: np.ndarray, value: np.ndarray) -> np.ndarray:
    return np.where(test, value, 0.0)


class Counted:
    """``plain``: PLAIN per piece; ``judged``: JUDGED of the stretches that lie within a piece; ``head`` and
    ``tail``: STRETCH of what a piece holds of the stretches it cuts; ``cut``: whether it ends one;
    ``shingle``: the distinct shingles of each piece."""

    def __init__(self, n: int):
        self.plain = np.zeros((n, len(PLAIN)))
        self.judged = np.zeros((n, len(JUDGED)))
        self.head, self.tail = np.zeros((n, len(STRETCH))), np.zeros((n, len(STRETCH)))
        self.cut = np.zeros(n, bool)
        self.shingle = np.zeros(0, np.uint64)


def _shift(a: np.ndarray, k: int, fill=0) -> np.ndarray:
    """``a[i + k]`` at ``i``."""
    out = np.full_like(a, fill)
    if k > 0:
        out[:-k] = a[k:]
    elif k < 0:
        out[-k:] = a[:k]
    return out


def _wraps(ends: np.ndarray, lengths: np.ndarray, reach: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Whether the break at each line's end only wraps: the line has no room for the next
    word at the width of the lines near it, and so have three in four of the breaks near it."""
    near_width = lengths.copy()
    for k in range(1, min(LINES_NEAR + 1, len(ends))):
        close = ends[k:] - ends[:-k] <= LINE_CHARS
        np.maximum(near_width[:-k], np.where(close, lengths[k:], 0), out=near_width[:-k])
        np.maximum(near_width[k:], np.where(close, lengths[:-k], 0), out=near_width[k:])
    n = valid.astype(np.int64)
    full_any = n * (reach > near_width)
    full, total = full_any.copy(), n.copy()
    for k in range(1, min(LINES_NEAR + 1, len(ends))):
        close = ends[k:] - ends[:-k] <= LINE_CHARS
        full[:-k] += full_any[k:] * close
        full[k:] += full_any[:-k] * close
        total[:-k] += n[k:] * close
        total[k:] += n[:-k] * close
    return valid & (near_width >= 16) & (4 * full >= 3 * total)


def count_pieces(c: np.ndarray, begin: np.ndarray, end: np.ndarray, lo: np.ndarray, hi: np.ndarray, first: np.ndarray, last: np.ndarray) -> Counted:
    """Counts of pieces that lie in ``c`` from ``begin`` to ``end``, each followed by one NUL, and are
    to be counted from ``lo`` to ``hi``. ``first`` and ``last`` tell that a text begins or ends with a piece's bounds."""
    pieces = len(begin)
    out = Counted(pieces)
    flags_of, mix = tables()
    np.minimum(c, _TOP - 1, out=c)
    f = flags_of[c]
    n = len(c)
    at = np.arange(n)
    # the piece a character is counted in, and -1 outside of what is counted
    core = np.full(n, -1, np.int64)
    size = hi - lo
    inside = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
    core[inside] = np.repeat(np.arange(pieces), size)
    piece = np.repeat(np.arange(pieces), end - begin + 1)
    stop = np.zeros(n, bool)
    stop[end] = True

    def per_piece(where: np.ndarray) -> np.ndarray:
        places = np.flatnonzero(where) if where.dtype == bool else where  # in order
        return np.searchsorted(places, hi) - np.searchsorted(places, lo)

    def has(bit: int) -> np.ndarray:
        return (f & bit) != 0

    column = {name: i for i, name in enumerate(PLAIN)}

    def put(name: str, values: np.ndarray) -> None:
        out.plain[:, column[name]] = values

    space, newline, letter, ender = has(SPACE), has(NEWLINE), has(LETTER), has(ENDER)
    unspaced, digit, latin, vowel = has(UNSPACED), has(DIGIT), has(LATIN), has(VOWEL)
    put("n_chars", size)
    n_space, n_letter, n_digit = per_piece(space), per_piece(letter | has(MARK)), per_piece(digit)
    put("n_spaces", n_space)
    put("n_letters", n_letter)
    put("n_digits", n_digit)
    put("n_symbols", size - n_space - n_letter - n_digit)
    put("n_unspaced", per_piece(unspaced))
    put("n_latin", per_piece(latin))
    put("n_vowels", per_piece(vowel))
    put("n_joins", per_piece(has(JOINER) & ~space))

    before, after = _shift(c, -1), _shift(c, 1)
    f_after = _shift(f, 1)
    solid = ~space & ~stop
    solid_upto = np.cumsum(solid)

    # lines: their ends, starts, lengths, whether they have text
    line_end = np.flatnonzero(newline | stop)
    line_start = np.empty_like(line_end)
    if len(line_end):
        line_start[0], line_start[1:] = 0, line_end[:-1] + 1
    # a piece may begin amid a line, far enough before what is counted
    amid = np.zeros(len(line_end), bool)
    amid[np.searchsorted(line_start, begin[~first])] = True
    length = np.minimum(line_end - line_start, LINE_CHARS)
    count_to = np.concatenate([[0], solid_upto])
    full_line = count_to[line_end] > count_to[line_start]
    # the last solid mark of a line but for closers tells whether it ends like a sentence
    telling = solid & ~has(CLOSER)
    last_telling = np.maximum.accumulate(np.where(telling, at, -1))
    final = last_telling[np.maximum(line_end - 1, 0)]
    ends_well = full_line & (final >= line_start) & ((f[np.maximum(final, 0)] & (ENDER | WIDE_ENDER)) != 0)

    # list items: what stands before their text is left out
    item = np.zeros(n, bool)
    hidden = np.zeros(n, bool)
    next_solid = np.minimum.accumulate(np.where(solid | newline | stop, at, n)[::-1])[::-1] if n else at
    mark_at = next_solid[line_start] if len(line_start) else line_start
    look = [np.minimum(mark_at + k, n - 1) for k in range(6)]
    blank = lambda p: space[p] & ~newline[p]
    simple = ((f[look[0]] & BULLET) != 0) & blank(look[1])
    mark_len = np.where(simple, 1, 0)
    for opened in (0, 1):
        lead = c[look[0]] == ord("(") if opened else np.ones(len(look[0]), bool)
        for digits in (1, 2, 3):
            label = np.ones(len(look[0]), bool)
            for k in range(digits):
                label &= digit[look[opened + k]]
            if digits == 1:
                label |= latin[look[opened]] & (c[look[opened]] < 128)
            close_at = look[opened + digits]
            closing = (c[close_at] == ord(".")) | (c[close_at] == ord(")"))
            numbered = lead & label & closing & blank(np.minimum(close_at + 1, n - 1))
            mark_len = np.where(numbered & (mark_len == 0), opened + digits + 1, mark_len)
    is_item = (mark_len > 0) & (mark_at < line_end) & ~amid
    items, lens = mark_at[is_item], mark_len[is_item]
    item[items] = True
    for k in range(5):
        hidden[items[lens > k] + k] = True
    put("n_lines", per_piece(mark_at[full_line & ~amid]))
    put("n_end_lines", per_piece(final[ends_well]))
    put("n_bullet_lines", per_piece(items))

    # short brackets with figures are left out, too
    bracket = np.flatnonzero(((c == ord("(")) | (c == ord("[")) | (c == ord(")")) | (c == ord("]"))) & ~hidden)
    if len(bracket) > 1:
        a, b = bracket[:-1], bracket[1:]
        opening = (c[a] == ord("(")) | (c[a] == ord("["))
        closing = (c[b] == ord(")")) | (c[b] == ord("]"))
        figures = np.concatenate([[0], np.cumsum(digit)])
        breaks = np.concatenate([[0], np.cumsum(newline | stop)])
        good = opening & closing & (b - a <= 62) & (figures[b] > figures[a]) & (breaks[b] == breaks[a])
        delta = np.zeros(n + 1, np.int32)
        delta[a[good]] += 1
        delta[b[good] + 1] -= 1
        hidden |= np.cumsum(delta[:-1]) > 0

    shown = ~hidden
    letter_s = letter & ~unspaced
    wordy = letter_s | (has(MARK) & ~unspaced)
    word_start = wordy & ~_shift(wordy, -1)
    starts = np.flatnonzero(word_start)
    stops = np.flatnonzero(wordy & ~_shift(wordy, 1)) + 1

    # wrapped lines
    soft = np.zeros(n, bool)
    if len(line_end) > 1:
        spaces = np.flatnonzero(space | stop)
        nxt = np.minimum(next_solid[np.minimum(line_end + 1, n - 1)], n - 1)
        reach_end = spaces[np.minimum(np.searchsorted(spaces, nxt), len(spaces) - 1)]
        first_word = np.where(unspaced[nxt], 1, np.minimum(reach_end - nxt, WORD_CHARS) + 1)
        follows = np.append(full_line[1:], False) & ~stop[line_end]
        item_next = np.append(is_item[1:], False)
        valid = full_line & follows & ~is_item & ~item_next
        # pieces are kept apart by giving each a span of positions of its own
        apart = line_end + piece[line_end] * (2 * LINE_CHARS)
        wraps = _wraps(apart, length, length + first_word, valid)
        soft[line_end[wraps]] = True

    # cells of tables and lists in a line
    dot = c == ord(".")
    four = dot & _shift(dot, 1, False) & _shift(dot, 2, False) & _shift(dot, 3, False)
    leader = four | _shift(four, -1, False) | _shift(four, -2, False) | _shift(four, -3, False)
    spaced = dot & _shift(space, 1, False)
    spaced = spaced & _shift(spaced, 2, False) & _shift(spaced, 4, False)
    leader |= spaced | _shift(spaced, -2, False) | _shift(spaced, -4, False)
    gap = space & ~newline
    gap3 = gap & _shift(gap, 1, False) & _shift(gap, 2, False) & ((_shift(solid, -1, False)))
    slash = (c == ord("/")) & _shift(space, -1, False) & _shift(space, 1, False)
    semi = (c == ord(";")) & ~(_shift(gap, 1, False))
    headed = ((c == ord(":")) | (c == 0xFF1A)) & (_shift(newline, 1, False) | (_shift(gap, 1, False) & _shift(newline, 2, False)))
    cell = (has(CELL) | leader | gap3 | slash | semi | headed) & ~hidden & ~stop

    # sentence ends
    wide = has(WIDE_ENDER)
    runs_on = (f_after & (LETTER | DIGIT | MARK | ENDER | WIDE_ENDER)) != 0
    runs_on |= (after == ord(",")) | (after == ord(";")) | (after == ord(":")) | (after == ord("/")) | (after == ord("-")) | (after == ord("_"))
    ends = ((ender & ~runs_on) | (wide & ((f_after & (ENDER | WIDE_ENDER)) == 0))) & ~hidden & ~leader

    hard = newline & ~soft
    parts = ends | hard | cell
    delimiter = parts & (core >= 0)
    # a text's end ends its last stretch
    text_end = hi[last] - 1
    text_end = text_end[size[last] > 0]

    # glued runs
    run = solid & ~unspaced & ~wide
    run_start = run & ~_shift(run, -1, False)
    rs, re_ = np.flatnonzero(run_start), np.flatnonzero(run & ~_shift(run, 1, False)) + 1
    long_run = re_ - rs >= GLUED
    delta = np.zeros(n + 1, np.int32)
    delta[rs[long_run]] += 1
    delta[re_[long_run]] -= 1
    glued = np.cumsum(delta[:-1]) > 0
    put("n_glued", per_piece(glued))

    # words
    k = len(starts)
    kind = core[starts]
    real = np.zeros(0, bool)
    words = np.zeros(0, np.uint64)
    odd = is_common = short = other = np.zeros(0, bool)
    wv = wl = np.zeros(0)
    if k:
        upto = lambda mask: np.concatenate([[0], np.cumsum(mask)])
        within = lambda sums: sums[stops] - sums[starts]
        size_w = stops - starts
        letters_w = within(upto(letter_s))
        real = letters_w > 0
        place = at - np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [n]])))
        value = np.where(wordy & (place < WORD_CHARS), mix[c] * _POWERS[np.minimum(place, WORD_CHARS - 1)], np.uint64(0))
        words = np.add.reduceat(value, starts)
        table = _common_hashes()
        is_common = table[np.minimum(np.searchsorted(table, words), len(table) - 1)] == words
        lat_w, vow_w = within(upto(latin & wordy)), within(upto(vowel & wordy))
        upper = has(UPPER) & wordy
        up_w, low_w = within(upto(upper)), within(upto(has(LOWER) & wordy))
        same = wordy & _shift(wordy, -1, False) & (mix[c] == mix[before])
        triple = same & _shift(same, -1, False)
        four_same = triple & _shift(triple, -1, False)
        consonant = latin & ~vowel & wordy
        six = consonant.copy()
        for j in range(1, 6):
            six &= _shift(consonant, -j, False)
        all_latin = (lat_w == letters_w) & (letters_w == size_w) & real
        ratio = vow_w / np.maximum(letters_w, 1)
        odd = (size_w > 40) | (within(upto(four_same)) > 0)
        odd |= within(upto((c == ord("q")) & wordy & ((f_after & LATIN) != 0) & (after != ord("u")))) > 0
        odd |= all_latin & (size_w >= 3) & (vow_w == 0) & (up_w < size_w)
        odd |= all_latin & (size_w >= 5) & ((ratio < 0.15) | (ratio > 0.85))
        odd |= within(upto(six)) > 0
        first_up = (f[starts] & UPPER) != 0
        odd |= (size_w >= 4) & (up_w - first_up >= 1) & (low_w - ((f[starts] & LOWER) != 0) >= 1)
        odd &= real & ~glued[starts]
        is_common &= real
        short = real & (lat_w > 0) & (size_w <= 2) & (up_w < 2)
        other = real & (lat_w == 0)
        put("n_words", per_piece(starts[real]))
        put("n_word_chars", per_piece(letter_s))
        put("n_common", per_piece(starts[is_common]))
        put("n_odd", per_piece(starts[odd]))
        pair = wordy & latin & _shift(wordy & latin, -1, False)
        put("n_pairs", per_piece(pair))
        put("n_turns", per_piece(pair & (vowel != _shift(vowel, -1, False))))
        put("n_triples", per_piece(np.flatnonzero(triple)))
        echo = np.zeros(k, bool)
        echo[1:] = (words[1:] == words[:-1]) & (piece[starts[1:]] == piece[starts[:-1]]) & (starts[1:] - starts[:-1] <= SHINGLE_CHARS)
        put("n_echoes", per_piece(starts[echo & real]))
        wv, wl = vow_w, lat_w
    final_end = ends & _shift(stop, 1, False)
    put("n_last_enders", per_piece(np.flatnonzero(final_end)))

    # stretches: numbered by the delimiters before them, and by pieces
    opens = np.zeros(n, bool)
    opens[1:] = delimiter[:-1]
    opens[lo[size > 0]] = True
    open_at = np.flatnonzero(opens & (core >= 0))
    number = np.cumsum(opens & (core >= 0)) - 1
    total = len(open_at)
    if total:
        owner = core[open_at]
        v = np.zeros((len(STRETCH), total))
        add = lambda where, weights=None: np.bincount(number[where], weights=weights, minlength=total)[:total]
        mine = real & (kind >= 0) & ~glued[starts] & shown[starts] if k else np.zeros(0, bool)
        ws = starts[mine] if k else starts
        us = np.flatnonzero(unspaced & shown & (core >= 0))
        gl = np.flatnonzero(glued & (core >= 0) & (number >= 0))
        kana = us[(f[us] & KANA) != 0]
        v[0] = add(ws) + add(us) / UNSPACED_WORD + add(gl) / GLUED_WORD
        if k:
            seen = (is_common | short) & mine
            v[1] = add(starts[seen]) + 0.3 * add(starts[other & mine])
            v[2] = add(starts[is_common & mine])
            v[3] = add(starts[odd & mine])
            # words that begin a stretch, and with a capital
            edge = parts.copy()
            edge[end] = True
            last_edge = np.maximum.accumulate(np.where(edge, at, -1))
            behind = np.concatenate([[-2], stops[:-1] - 1])
            leads = (last_edge[starts] > behind) & ((f[starts] & UPPER) != 0)
            v[7] = add(starts[leads & mine])
            v[8] = add(ws, wv[mine])
            v[9] = add(ws, wl[mine])
        v[1] += 0.7 * add(kana) / UNSPACED_WORD + 0.1 * add(us[(f[us] & (KANA | KATAKANA)) == 0]) / UNSPACED_WORD
        v[3] += add(gl) / GLUED_WORD
        between = space & _shift(unspaced, -1, False) & _shift(unspaced, 1, False)
        v[4] = add(np.flatnonzero(((has(COMMA) & shown) | (between & ~newline)) & (core >= 0)))
        left = np.zeros(n, bool)
        left[1:] = cell[:-1]
        v[5] = add(np.flatnonzero((cell | left | item) & (core >= 0)))
        v[6] = add(np.flatnonzero(ends & (core >= 0)))
        v[10] = add(us)

        firsts = np.zeros(total, bool)
        firsts[np.searchsorted(owner, np.arange(pieces)[size > 0])] = True
        lasts = np.append(firsts[1:], True)
        closes = np.zeros(total, bool)
        closes[number[np.flatnonzero(delimiter)]] = True
        closes[number[text_end]] = True
        within_text = np.ones(total, bool)
        within_text[firsts & ~first[owner]] = False
        whole_piece = first & last
        head_of = firsts & ~whole_piece[owner]
        tail_of = lasts & ~closes & ~head_of
        done = ~head_of & ~tail_of
        judged = np.array(judge(v[:, done], pick_array))
        for j in range(len(JUDGED)):
            out.judged[:, j] = np.bincount(owner[done], weights=judged[j], minlength=pieces)
        out.head[owner[head_of]] = v[:, head_of].T
        out.tail[owner[tail_of]] = v[:, tail_of].T
        out.cut[owner[closes]] = True

    # shingles of words, and of characters where no spaces part words
    tokens = np.flatnonzero(word_start | unspaced)
    value = mix[c[tokens]]
    if k:
        value[np.searchsorted(tokens, starts)] = words
    found = [_shingles(value, tokens, length, core, piece) for length in SHINGLES]
    for name, (p, h) in zip(("shingles", "runs"), found):
        put(f"n_{name}", np.bincount(p, minlength=pieces))
    p = np.concatenate([x[0] for x in found])
    # the last bit of a shingle's number tells its length
    h = np.concatenate([(x[1] & ~np.uint64(1)) | np.uint64(i) for i, x in enumerate(found)])
    order = np.argsort(h ^ (p.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4E)))
    p, h = p[order], h[order]
    new = np.ones(len(order), bool)
    new[1:] = (h[1:] != h[:-1]) | (p[1:] != p[:-1])
    owners, out.shingle = p[new], h[new]
    for i, name in enumerate(("shingles", "runs")):
        put(f"n_distinct_{name}", np.bincount(owners[(out.shingle & np.uint64(1)) == i], minlength=pieces))
    return out


def _shingles(value: np.ndarray, tokens: np.ndarray, length: int, core: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(piece, number) of each run of ``length`` words that begins in what is counted."""
    m = max(len(tokens) - length + 1, 0)
    h = np.zeros(m, np.uint64)
    for j in range(length):
        h = h * np.uint64(0x9FB21C651E98DF25) + value[j : j + m]
        h ^= h >> np.uint64(29)
    a, b = tokens[:m], tokens[len(tokens) - m :]
    good = (core[a] >= 0) & (piece[a] == piece[b]) & (b - a <= SHINGLE_CHARS)
    return core[a[good]], h[good]


def _code_points(data: bytes) -> np.ndarray:
    """Code points of UTF-8 bytes; NUL, which parts pieces, and broken bytes are stood in for."""
    points = np.frombuffer(data.decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32).copy()
    return points


def _group(rows: list[int], chunks: list[int], parts: list[np.ndarray], core: list[tuple[int, int]], ends: list[tuple[bool, bool]]):
    length = np.array([len(p) for p in parts], np.int64)
    begin = np.cumsum(length + 1) - length - 1
    c = np.zeros(int((length + 1).sum()), np.uint32)
    for b, p in zip(begin.tolist(), parts):
        c[b : b + len(p)] = p
    lo, hi = (begin + np.array([x[i] for x in core], np.int64) for i in (0, 1))
    first, last = (np.array([x[i] for x in ends], bool) for i in (0, 1))
    return np.array(rows, np.int64), np.array(chunks, np.int64), count_pieces(c, begin, begin + length, lo, hi, first, last), first & last


def count_texts(texts: Sequence[bytes | None], chunk: int, group: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray, Counted, np.ndarray]]:
    """(rows, chunks, counts, whole) of the texts' pieces of ``chunk`` characters, some texts or pieces
    of about ``group`` characters at a time; ``whole`` tells which texts are one piece."""
    rows: list[int] = []
    small: list[bytes] = []
    held = 0
    for i, text in enumerate(texts):
        text = (text or b"").replace(b"\0", b"\xef\xbf\xbd")
        if len(text) <= chunk:
            rows.append(i)
            small.append(text)
            held += len(text) + 1
            if held >= group:
                yield _whole(rows, small)
                rows, small, held = [], [], 0
            continue
        points = _code_points(text)
        starts = range(0, len(points), chunk)
        at_once = max(1, group // (chunk + BEFORE + AFTER))
        seen: list[np.ndarray] = []
        for k in range(0, len(starts), at_once):
            step = []
            for n, at in enumerate(starts[k : k + at_once], k):
                a, b = max(0, at - BEFORE), min(len(points), at + chunk + AFTER)
                step.append((i, n, points[a:b], (at - a, min(at + chunk, len(points)) - a), (at == 0, at + chunk >= len(points))))
            found = _group(*map(list, zip(*step)))
            counted = found[2]
            # shingles differ over the whole text; its last piece tells how many
            seen.append(np.unique(counted.shingle))
            counted.plain[:, DISTINCT] = 0
            if k + at_once >= len(starts):
                every = np.unique(np.concatenate(seen)) & np.uint64(1)
                counted.plain[-1, DISTINCT] = [(every == 0).sum(), (every == 1).sum()]
            yield found
    if rows:
        yield _whole(rows, small)


def _whole(rows: list[int], texts: list[bytes]):
    c = _code_points(b"\0".join(texts) + b"\0")
    end = np.flatnonzero(c == 0)
    begin = np.append(0, end[:-1] + 1)
    every = np.ones(len(rows), bool)
    return np.array(rows, np.int64), np.zeros(len(rows), np.int64), count_pieces(c, begin, end, begin, end, every, every), every


def total(counted: Counted) -> dict[str, float]:
    """The counts of one text out of those of all its pieces in order, put together at the cuts."""
    plain, judged = counted.plain.sum(axis=0), counted.judged.sum(axis=0)
    carry = np.zeros(len(STRETCH))
    for k in range(len(counted.cut)):
        carry = carry + counted.head[k]
        if counted.cut[k]:
            judged = judged + np.array([float(x) for x in judge(carry, lambda t, v: v if t else 0.0)])
            carry = counted.tail[k]
    return dict(zip(COUNTS, [*plain, *judged]))


def count(text: str) -> dict[str, float]:
    """The counts of one text."""
    (_, _, counted, _), = count_texts([text.encode()], max(1, len(text.encode())))
    return total(counted)


#: A text whose long shingles stand in it so often, on average, says one thing over and over; so does one
#: that has too few of these if its short ones do.
REPEATED_RUNS, FEW_RUNS, REPEATED = 2.5, 40, 3.0
#: Words and characters of a short phrase.
PHRASE_WORDS, PHRASE_CHARS = 6, 80


def prose_rule(c, pick):
    """Whether a text with the counts ``c`` is natural prose, or a list, table or junk. Values may be arrays or columns."""
    words, n_words = c["unit_words"], c["n_words"]
    solid = c["n_chars"] - c["n_spaces"]
    sentences = sentence_words(c, pick)
    few = c["n_runs"] < FEW_RUNS
    repeated = (~few & (c["n_runs"] >= REPEATED_RUNS * c["n_distinct_runs"])) | (few & (c["n_shingles"] >= REPEATED * c["n_distinct_shingles"]) & (c["n_shingles"] > 0))
    repeated |= (n_words >= 3) & (c["n_echoes"] >= 0.5 * n_words)
    salad = (c["salad_words"] >= 0.5 * words) | ((n_words >= SALAD_WORDS + 2) & (c["n_common"] > SALAD_SHARE * n_words))
    odd = c["n_odd"] + c["n_glued"] / GLUED_WORD > ODD_SHARE * words
    unsaid = (c["n_pairs"] >= 40) & (c["n_turns"] < TURNS * c["n_pairs"])
    unsaid |= (c["n_latin"] >= 12) & ((c["n_vowels"] < VOWELS_LEAST * c["n_latin"]) | (c["n_vowels"] > VOWELS_MOST * c["n_latin"]))
    junk = (words <= 0) | repeated | salad | odd | unsaid | (c["n_symbols"] > 0.5 * solid) | ((c["n_letters"] < 0.5 * solid) & (sentences < 0.5 * words))
    short = (words < 7) & (c["n_units"] <= 2) & (c["n_lines"] <= 1) & (c["n_bullet_lines"] == 0)
    vowels = (c["n_latin"] == 0) | ((c["n_vowels"] >= 0.25 * c["n_latin"]) & (c["n_vowels"] <= 0.65 * c["n_latin"]))
    plain = (n_words >= 2) & (n_words <= PHRASE_WORDS) & (c["n_chars"] <= PHRASE_CHARS) & (c["n_word_chars"] >= 3 * n_words) & (c["n_digits"] == 0)
    plain = plain & (c["n_symbols"] - c["n_joins"] <= c["n_last_enders"]) & vowels & (c["n_triples"] == 0) & (c["n_echoes"] == 0) & (c["n_odd"] == 0)
    phrase = plain | (((c["n_common"] >= 1) | ((c["n_unspaced"] > 0) & (c["evidence"] >= 1))) & (c["n_symbols"] <= 0.25 * solid)) | (sentences > 0)
    return ~junk & ((short & phrase) | (~short & (sentences >= 0.5 * words)))


def sentence_words(c, pick):
    """Words that stand in sentences. What counts as one among lines that nothing ends depends on the text's other lines."""
    celled = c["marked_words"] >= MARKED_SHARE * c["unit_words"]
    listed = (c["n_open"] > 2) & (c["open_words"] < LINE_MEAN * c["n_open"])
    alone = c["n_open"] <= 1
    return c["closed_words"] + pick(~celled & listed, c["open_75"]) + pick(~celled & ~listed & alone, c["open_35"]) + pick(~celled & ~listed & ~alone, c["open_45"])


def is_prose(c: dict[str, float]) -> bool:
    """The rule's outcome for the counts of one text."""
    return bool(prose_rule(c, lambda test, value: value if test else 0.0))
