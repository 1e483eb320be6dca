"""Sentence boundaries across languages and scripts.

The boundary rules are compiled into a finite transducer.  Its input is one class per code
point: what the point is, and what lies beside it (the word before a period is an
abbreviation, a name's title, a short number; a closing mark stands behind a sentence mark).
Vectorised passes find the classes; they look at neighbours and at the word before a period
only.  Every rule about what follows is a state.  A sentence mark makes the end pending, and
the next telling point decides: a small letter takes it back, a capital confirms it, a digit
or a month's name takes it back after "No." or "3.", while blanks, dashes and opening signs
keep it pending (and are remembered, as they belong to the new sentence).  The other states
say whether a sentence has begun and which quotation or bracket is open, and how it was
opened.

The transducer writes two marks: where an end became pending and where it was confirmed; the
latest pending place before a confirmation is the boundary.  Texts run side by side; a text
without empty lines for long is cut into chunks, whose functions from states to states are
composed by the parallel prefix scan of ``scan``.

Rules
-----
* An empty line, or one of white space only, ends a sentence; a single line break never does.
* A single line between empty lines that is marked as heading (``== .. ==``), table row
  (``| .. |``) is one sentence whatever marks it holds.
* Sentence marks inside quotation marks or brackets do not end the sentence around them.
  A quotation that ends with a mark ends its sentence if a new one follows: a capital, or, in
  scripts without case, if the quotation did not open the sentence (then the words that
  report it come first; else they follow).
* A period does not end a sentence after abbreviations, initials and in numbers, nor before a
  small letter; the blank after a mark may be missing before a capitalised word.
* Thai and Lao write no mark: the blank between two of their letters is the boundary.

Defined results
---------------
* Null, empty and blank texts have no sentences.  Rows are kept one to one, so repeated rows
  give repeated sentences.  Positions count code points from 0, end exclusive.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan
from .textbatch import Joined, SliceHasher, blocks

# kinds of code points
OTHER, SPACE, LOWER, UPPER, CASELESS, DIGIT = range(6)
# input classes
(
    X, WS, GAP, CUT, LOW, UP, UP_ORDINAL, NOCASE, NUMBER, COMMA, LEAD, DASH, OPEN_QUOTE,
    M_ANY, M_LOW, M_WIDE, M_NUMBER, M_SHORT,
    OPEN2, OPEN2_SAYS, OPEN1, OPEN_B,
    CLOSE2, CLOSE2_END, CLOSE2_END_WS, BOTH2, BOTH2_END, BOTH2_END_WS, BOTH2_SAYS,
    CLOSE1, CLOSE1_END, CLOSE_B, CLOSE_B_END,
) = range(33)
CLASSES = 33
MARKS = (M_ANY, M_LOW, M_WIDE, M_NUMBER, M_SHORT)  # the end is pending unless: small letter or comma; the same, but a small letter right behind a blank confirms; comma; as the first or digit; as the first or month
OPENS = {OPEN2: 2, OPEN1: 1, OPEN_B: 3, BOTH2: 2, BOTH2_END: 2, BOTH2_END_WS: 2, BOTH2_SAYS: 2}
CLOSES2, CLOSES1, CLOSES_B = (CLOSE2, CLOSE2_END, CLOSE2_END_WS), (CLOSE1, CLOSE1_END), (CLOSE_B, CLOSE_B_END)
FIRST, LATER, SAID = range(3)  # how a quotation was opened: at the sentence's start, later, behind a colon

# The sentence marks of the scripts, and abbreviations, as they are written (lower case).
STRONG = "!?。！？｡؟۔।॥‼⁇⁈⁉։።။។"
DOTS = ".…．"
OPENERS2, CLOSERS2, BOTH = "„«「《", "”»」》", "“\""
OPENERS1, CLOSERS1 = "‘『", "’』"
OPENERS_B, CLOSERS_B = "([（【", ")]）】"
DASHES = "-–—―*•"
BEFORE_NAMES = (  # told by case as well
    "Dr Prof Mr Mrs Ms St Ste Capt Gen Col Lt Sgt Rev Hon Messrs Mme Mlle MM Hrn Hr Fr Sr Sra Srta Dra Dña D.ª dr prof vgl Vgl cf Cf vs Vs bzw z.B Z.B d.h D.h u.a i.d.R e.g E.g i.e I.e "
    "viz p.ej P.ej ex z d u i p t e o b ü т c π.χ δρ Δρ κ κα κκ αγ ул Ул проф Проф акад Акад им см См т.е т.к д-р डॉ प्रो पृ श्री श्रीमती कि.मी कि से.मी सं पं د أ م.م nr refs"
).split()
BEFORE_NUMBERS = (
    "no nr nos fig figs abb vol vols p pp art abs bd s ca approx aprox pág págs pag cap chap t env jan feb mar apr jun jul aug sep sept oct okt nov dec dez "
    "ch sec sect ed eq стр рис изд гл табл с п кн том ver v núm núms num n.º σελ εικ κεφ kap lfg тел ص ج tab taf anm l nº"
).split()
BEFORE_SMALL = (
    "etc usw jr sr ave al co bros inc ltd corp sen jun a.m p.m am pm est dept univ ff max min ed eds lic resp ggf sog bspw etw inkl exkl mio mrd tel str hl geb gest av env ap "
    "ej aprox admón тыс млн млрд гг вв чел руб коп др пр т.д т.п ул обл χλμ κ.λπ κλπ δηλ μ.χ εκ χιλ km kg cm mm ml hz kw mi ft in oz lb yr hr hrs sec h m s g l"
).split()
ORDINAL_NOUNS = "jahrhundert jahrhunderts jahrhunderte jh januar februar märz april mai juni juli august september oktober november dezember kapitel auflage".split()


def _opened(sign: int, begins: bool) -> tuple:
    return ("quote", sign, FIRST if begins else LATER) if sign else (("start",) if begins else ("inside",))


def _step(state: tuple, c: int) -> tuple[tuple, bool, str]:
    """(next state, whether an end becomes pending here, "" or the end that is confirmed: "here" or "pending")."""
    if c == GAP:
        return ("start",), False, "here"
    if c == WS or (c == CUT and state[0] != "inside"):
        return state, False, ""
    if c == CUT:
        return ("start",), False, "here"
    what = state[0]
    if what in ("start", "inside"):
        if c in OPENS and c != BOTH2_SAYS:
            return _opened(OPENS[c], what == "start"), False, ""
        if c in (OPEN2_SAYS, BOTH2_SAYS):
            return ("quote", 2, SAID), False, ""
        if c in MARKS and what == "inside":
            return ("pending", c, 0), True, ""
        return ("inside",), False, ""
    if what == "quote":
        _, sign, how = state
        if sign == 3:
            if c == CLOSE_B_END and how == FIRST:
                return ("closed", LATER), True, ""
            return (("inside",) if c in CLOSES_B else state), False, ""
        plain, ended, spaced = {2: ((CLOSE2, BOTH2, BOTH2_SAYS), (CLOSE2_END, BOTH2_END), (CLOSE2_END_WS, BOTH2_END_WS)), 1: ((CLOSE1,), (CLOSE1_END,), ())}[sign]
        if c in ended:
            return ("closed", FIRST if how == FIRST else LATER), True, ""
        if c in spaced:
            return ("closed", how), True, ""
        return (("inside",) if c in plain else state), False, ""
    if what == "pending":
        _, mark, sign = state
        softer = M_ANY if mark == M_LOW else mark
        if c in OPENS:
            return ("pending", softer, sign or OPENS[c]), False, ""
        if c in (LEAD, DASH, OPEN_QUOTE, *CLOSES2, *CLOSES1, *CLOSES_B):
            return ("pending", softer, sign), False, ""
        no = c == COMMA or (c == LOW and mark not in (M_LOW, M_WIDE)) or (c == NUMBER and mark == M_NUMBER) or (c == UP_ORDINAL and mark == M_SHORT)
        return _step(_opened(sign, not no), c)[0], False, "" if no else "pending"
    # a quotation or bracket closed behind a mark; signs seen since: nothing, a quotation's, a dash, another
    _, how, *seen = state
    since, sign = seen if seen else ("", 0)
    if c in OPENS or c in (LEAD, DASH, OPEN_QUOTE):
        if not since:
            since = "quote" if c == OPEN_QUOTE or OPENS.get(c) in (1, 2) else "dash" if c == DASH else "other"
        kept = how if since == "other" else LATER
        return ("closed", FIRST if kept == FIRST else LATER, since, sign or OPENS.get(c, 0)), False, ""
    sure = c in (UP, UP_ORDINAL) or (c == NUMBER and since != "dash") or (c == NOCASE and since == "quote")
    maybe = (c == NOCASE and since in ("", "other") and how != FIRST) or (c == LOW and not since and how == SAID)
    end = sure or maybe
    after, pending, _ = _step(_opened(sign, end), c)
    return after, pending, "pending" if end else ""


def _machine() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(delta, pends, ends) by class and state, the start being state 0; ends: 0 none, 1 behind this point, 2 at the pending place."""
    states, at = [("start",)], {("start",): 0}
    rows = []
    for state in states:  # grows while new states are met
        row = []
        for c in range(CLASSES):
            nxt, pends, ends = _step(state, c)
            if nxt not in at:
                at[nxt] = len(states)
                states.append(nxt)
            row.append((at[nxt], pends, ("", "here", "pending").index(ends)))
        rows.append(row)
    table = np.array(rows).transpose(2, 1, 0)
    return table[0].astype(np.uint8), table[1].astype(bool), table[2].astype(np.uint8)


DELTA, PENDS, ENDS = _machine()
STATES = DELTA.shape[1]


class _Tables:
    def __init__(self) -> None:
        import unicodedata

        kind = np.zeros(0x110000, np.uint8)
        lower = np.arange(0x110000, dtype=np.uint32)
        for point in range(0x110000):
            c = chr(point)
            cat = unicodedata.category(c)
            if c.isspace():
                kind[point] = SPACE
            elif cat == "Ll":
                kind[point] = LOWER
            elif cat in ("Lu", "Lt"):
                kind[point] = UPPER
                low = c.lower()
                if len(low) == 1:
                    lower[point] = ord(low)
            elif cat[0] in "LM":
                kind[point] = CASELESS
            elif cat[0] == "N":
                kind[point] = DIGIT
        self.kind, self.lower = kind, lower
        self.role = np.zeros(0x110000, np.uint8)  # what a sign may be
        for i, signs in enumerate((STRONG, DOTS, OPENERS2, CLOSERS2, BOTH, OPENERS1, CLOSERS1, OPENERS_B, CLOSERS_B, DASHES + "¿¡'#|>{"), 1):
            self.role[[ord(c) for c in signs]] = i
        self.role[[0x3B, 0x37E]] = 11
        self.dash, self.comma = np.zeros(0x110000, bool), np.zeros(0x110000, bool)
        self.dash[[ord(c) for c in "-–—―"]] = True
        self.comma[[ord(c) for c in ",;:،؛、，；："]] = True
        self.names = _hashes(BEFORE_NAMES)
        self.numbers = _hashes(BEFORE_NUMBERS)
        self.ordinals = _hashes(ORDINAL_NOUNS)
        self.small = _hashes([*BEFORE_SMALL, *(w.lower() for w in BEFORE_NAMES if len(w) < 3 or w[0].islower()), *BEFORE_NUMBERS])
        self.gram = _hashes(["г"])


R_STRONG, R_DOT, R_OPEN2, R_CLOSE2, R_BOTH, R_OPEN1, R_CLOSE1, R_OPEN_B, R_CLOSE_B, R_LEAD, R_SEMI = range(1, 12)


def _hashes(words: list[str]) -> np.ndarray:
    text = "\n".join(words) + "\n"
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    stop = np.flatnonzero(points == 10)
    return np.unique(SliceHasher(points).of(np.r_[0, stop[:-1] + 1], stop))


@lru_cache(1)
def _tables() -> _Tables:
    return _Tables()


def _next_of(positions: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The first of the sorted ``positions`` at or after ``at``; ``n`` if there is none."""
    k = np.searchsorted(positions, at)
    return np.where(k < len(positions), positions[np.minimum(k, max(0, len(positions) - 1))] if len(positions) else n, n)


def _script_range(points: np.ndarray, *ranges: tuple[int, int]) -> np.ndarray:
    hit = np.zeros(len(points), bool)
    for lo, hi in ranges:
        hit |= (points >= lo) & (points <= hi)
    return hit


def boundaries(points: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, stops) of the sentences; ``breaks`` are the separators between texts."""
    t = _tables()
    n = len(points)
    kind = t.kind[points]
    role = t.role[points]
    kind[breaks] = SPACE
    role[breaks] = 0
    white = kind == SPACE
    sym = np.where(white, np.uint8(WS), np.uint8(X))
    solid = np.flatnonzero(~white)

    # -- empty lines ---------------------------------------------------------------------
    line = np.flatnonzero(white & ((points == 10) | (points == 13) | (points == 0x0B) | (points == 0x0C) | (points == 0x85) | (points == 0x2028) | (points == 0x2029)))
    gap = np.zeros(n, bool)
    gap[breaks] = True
    if len(line):
        # a line end; the \n of \r\n belongs to its \r
        tail = (points[line] == 10) & (line > 0) & (points[np.maximum(line - 1, 0)] == 13)
        line = line[~tail]
        if len(line) > 1:
            between = np.searchsorted(solid, line[1:]) == np.searchsorted(solid, line[:-1])
            gap[line[1:][between]] = True
        gap[line[points[line] == 0x2029]] = True
    sym[gap] = GAP
    gaps = np.flatnonzero(gap)

    def block(at: np.ndarray) -> np.ndarray:
        return np.searchsorted(gaps, at)

    if not len(solid):
        return np.empty(0, np.int64), np.empty(0, np.int64)

    # -- letters and signs -----------------------------------------------------------------
    second = np.r_[kind[1:], np.uint8(OTHER)]
    letter = np.array([X, WS, LOW, UP, NOCASE, NUMBER], np.uint8)[kind]
    solid_sym = (sym == X) & (letter != WS)
    sym[solid_sym] = letter[solid_sym]
    sym[(kind == LOWER) & (second == UPPER)] = UP  # pH
    sym[(role == R_LEAD)] = LEAD
    sym[t.dash[points] & (role == R_LEAD)] = DASH
    sym[t.comma[points]] = COMMA

    # -- sentence marks ------------------------------------------------------------------
    mark = (role == R_STRONG) | (role == R_DOT)
    semi = np.flatnonzero(role == R_SEMI)
    if len(semi):
        before = points[np.maximum(semi - 1, 0)]
        greek = _script_range(before, (0x370, 0x3FF), (0x1F00, 0x1FFF)) & (semi > 0)
        mark[semi[greek]] = True
        role[semi[greek]] = R_STRONG
        sym[semi[greek]] = X
    last = mark.copy()
    last[:-1] &= ~mark[1:]
    cand = np.flatnonzero(last)
    if len(cand):
        sym[cand] = _mark_classes(cand, points, kind, role, mark, white, t)
        capital = np.flatnonzero((kind == UPPER) & ~np.r_[False, (kind[:-1] == UPPER) | (kind[:-1] == LOWER)])
        if len(capital):
            stop = _next_of(np.flatnonzero(~((kind == LOWER) | (kind == UPPER))), capital, n)
            noun = np.isin(SliceHasher(t.lower[points]).of(capital, stop), t.ordinals)
            sym[capital[noun]] = UP_ORDINAL

    # -- headings and table rows -----------------------------------------------------------
    edge = np.r_[-1, gaps, n]
    k0, k1 = np.searchsorted(solid, edge[:-1] + 1), np.searchsorted(solid, edge[1:])
    full = k1 > k0
    first, final = solid[k0[full]], solid[k1[full] - 1]
    same_line = np.searchsorted(line, first) == np.searchsorted(line, final) if len(line) else np.ones(len(first), bool)
    marked = ((points[first] == 0x3D) & (points[final] == 0x3D)) | ((points[first] == 0x7C) & (points[final] == 0x7C)) | ((points[first] == 0x3C) & (points[final] == 0x3E)) | ((points[first] == 0x7B) & (points[final] == 0x7D))
    whole = same_line & marked & (final > first)
    if whole.any():
        cover = np.zeros(n + 1, np.int8)
        np.add.at(cover, first[whole], 1)
        np.add.at(cover, final[whole] + 1, -1)
        frozen = np.cumsum(cover[:-1]) > 0
    else:
        frozen = None

    # -- quotation marks and brackets --------------------------------------------------------
    def paired(opener: np.ndarray, closer: np.ndarray) -> np.ndarray:
        """Whether a closing sign comes later in the same block."""
        place = _next_of(closer, opener + 1, n)
        return (place < n) & (block(np.minimum(place, n - 1)) == block(opener))

    both = np.flatnonzero(role == R_BOTH)
    close2 = np.flatnonzero(role == R_CLOSE2)
    close1 = np.flatnonzero(role == R_CLOSE1)
    word = (kind == LOWER) | (kind == UPPER) | (kind == CASELESS) | (kind == DIGIT)
    if len(close1):
        inner = word[np.maximum(close1 - 1, 0)] & word[np.minimum(close1 + 1, n - 1)] & (points[close1] == 0x2019)
        close1 = close1[~inner]
    close_b = np.flatnonzero(role == R_CLOSE_B)
    open2, open1, open_b = (np.flatnonzero(role == r) for r in (R_OPEN2, R_OPEN1, R_OPEN_B))
    ends2 = np.sort(np.r_[close2, both])
    colon = np.r_[False, points[:-1] == 0x3A] | np.r_[False, points[:-1] == 0xFF1A]
    colon[1:] |= white[:-1] & colon[:-1]
    for at, closers, own, alone in ((open2, ends2, OPEN2, OPEN_QUOTE), (open1, close1, OPEN1, OPEN_QUOTE), (open_b, close_b, OPEN_B, LEAD)):
        sym[at] = np.where(paired(at, closers), own, alone)
    sym[open2[(sym[open2] == OPEN2) & colon[open2]]] = OPEN2_SAYS

    for at, plain, ended, spaced in ((close2, CLOSE2, CLOSE2_END, CLOSE2_END_WS), (both, BOTH2, BOTH2_END, BOTH2_END_WS), (close1, CLOSE1, CLOSE1_END, CLOSE1_END), (close_b, CLOSE_B, CLOSE_B_END, CLOSE_B_END)):
        if not len(at):
            continue
        prev = np.maximum(at - 1, 0)
        prev = np.where(white[prev], np.maximum(prev - 1, 0), prev)  # « Oui ! »
        beside = np.minimum(at + 1, n - 1)
        kana = _script_range(points[beside], (0x3041, 0x309F)) & ((points[at] == 0x300D) | (points[at] == 0x300F))
        sym[at] = np.where(mark[prev] & ~kana, np.where(white[beside], spaced, ended), plain)
    if len(both):  # the last of a block opens nothing
        alone = ~paired(both, ends2)
        sym[both[alone]] -= BOTH2 - CLOSE2
        sym[both[~alone & colon[both] & (sym[both] == BOTH2)]] = BOTH2_SAYS

    # -- scripts without sentence marks --------------------------------------------------------
    thai = _script_range(points, (0xE01, 0xE4E), (0xE81, 0xECD))
    if thai.any():
        at = np.flatnonzero(white[1:] & thai[:-1]) + 1  # first blank behind a letter
        nxt = _next_of(solid, at, n)
        ok = (nxt < n) & thai[np.minimum(nxt, n - 1)] & (points[np.minimum(nxt, n - 1)] != 0xE46) & (sym[at] == WS)
        ok &= block(np.minimum(nxt, n - 1)) == block(at)
        sym[at[ok]] = CUT
    if frozen is not None:
        sym[frozen & (sym != WS)] = X

    # -- run ---------------------------------------------------------------------------------
    state = scan.run_pieces(sym, DELTA, gaps)
    cell = sym.astype(np.int64) * STATES + state
    pending, what = np.flatnonzero(PENDS.ravel()[cell]), ENDS.ravel()[cell]
    late = np.flatnonzero(what == 2)
    ends = np.sort(np.r_[np.flatnonzero(what == 1), pending[np.searchsorted(pending, late) - 1]]) + 1
    edge = np.r_[0, ends, n]
    k = np.searchsorted(solid, edge)
    has = k[1:] > k[:-1]
    return solid[k[:-1][has]], solid[k[1:][has] - 1] + 1


def _mark_classes(cand, points, kind, role, mark, white, t) -> np.ndarray:  # noqa: ANN001
    """The input class of each mark that is the last of its run: from the mark, its neighbours and the word before it."""
    n = len(points)
    out = np.full(len(cand), X, np.uint8)
    nxt = np.minimum(cand + 1, n - 1)
    here = points[cand]
    blank = white[nxt] | (cand + 1 >= n)
    near = np.where(blank, OTHER, kind[nxt])
    closer = ~blank & np.isin(role[nxt], (R_CLOSE2, R_CLOSE1, R_CLOSE_B, R_BOTH))
    opener = ~blank & np.isin(role[nxt], (R_OPEN2, R_OPEN1))
    prev = np.maximum(cand - 1, 0)
    strong = role[cand] == R_STRONG
    after_strong = ~strong & (cand > 0) & mark[prev] & (role[prev] == R_STRONG)
    ellipsis = ~strong & ~after_strong & ((here == 0x2026) | ((cand > 0) & mark[prev] & (role[prev] == R_DOT)))
    beside = (near == UPPER) | (near == CASELESS) | closer | opener | (~blank & (role[nxt] == R_OPEN_B))
    out[strong] = np.where(here >= 0x80, M_WIDE, np.where(blank, M_LOW, np.where(beside, M_ANY, X)))[strong]
    out[after_strong | (ellipsis & (near != CASELESS) & (near != DIGIT))] = M_ANY
    single = ~strong & ~after_strong & ~ellipsis
    at = cand[single]
    if not len(at):
        return out
    stop_sign = white | (role == R_STRONG) | (role == R_OPEN_B) | (role == R_OPEN2) | (role == R_OPEN1) | (role == R_BOTH) | np.isin(points, [0x2014, 0x2013, 0x7C, 0x2F, 0x2019, 0x27])
    stops = np.flatnonzero(stop_sign)
    j = np.searchsorted(stops, at) - 1
    word_start = np.where(j >= 0, stops[np.maximum(j, 0)] + 1 if len(stops) else 0, 0)
    hasher, exact = SliceHasher(t.lower[points]), SliceHasher(points)
    h = hasher.of(word_start, at)
    size = at - word_start
    prev_kind, prev2_kind = kind[np.maximum(at - 1, 0)], kind[np.maximum(at - 2, 0)]
    letter_prev2 = (prev2_kind == LOWER) | (prev2_kind == UPPER) | (prev2_kind == CASELESS)
    initial = (prev_kind == UPPER) & ~(letter_prev2 & (at - 2 >= word_start))
    # behind a missing blank ("there.St. X"): the capitalised rest of the word
    inner = np.flatnonzero((points == 0x2E) & np.r_[(kind[1:] == UPPER), False])
    j = np.searchsorted(inner, at) - 1
    rest = np.where(j >= 0, inner[np.maximum(j, 0)] + 1 if len(inner) else 0, 0)
    rest_size = np.where(rest > word_start, at - rest, 0)
    rest = np.maximum(rest, word_start)
    name = np.isin(exact.of(word_start, at), t.names) | ((rest_size >= 2) & np.isin(exact.of(rest, at), t.names))
    gram = np.isin(h, t.gram) & (kind[np.maximum(word_start - 2, 0)] != DIGIT)
    short_number = (prev_kind == DIGIT) & (size <= 2) & (kind[np.minimum(word_start, n - 1)] == DIGIT)
    usual = np.where(np.isin(h, t.numbers), M_NUMBER, np.where(short_number, M_SHORT, M_ANY))
    prev_point = points[np.maximum(at - 1, 0)]
    indic = _script_range(prev_point, (0x900, 0xDFF), (0xE00, 0xEFF))
    unabbreviated = ((prev_kind == LOWER) & (prev2_kind != OTHER) & (size >= 2) & ~np.isin(h, t.small)) | ((prev_kind == DIGIT) & (size >= 3))
    bl, ne = blank[single], near[single]
    # no blank: a capitalised word behind a word of small letters or a number, or letters of a script without case
    beyond = kind[np.minimum(at + 2, n - 1)]
    glued = (ne == UPPER) & ((beyond == LOWER) | (beyond == SPACE)) & (((prev_kind == LOWER) & ((size >= 2) | (kind[np.maximum(at - 3, 0)] == DIGIT))) | (prev_kind == DIGIT) | (prev_kind == CASELESS))
    glued |= (ne == CASELESS) & (prev_kind == CASELESS) & (size >= 2) & ~indic & ~_script_range(prev_point, (0x3040, 0x30FF), (0x4E00, 0x9FFF))
    may = (bl & ~indic) | glued | closer[single] | opener[single]
    out[single] = np.where(~may | name | initial | gram, X, np.where(bl & unabbreviated, M_LOW, usual))
    return out


def spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, stop) of every sentence."""
    batch = Joined(texts)
    start, stop = boundaries(batch.points, batch.stop)
    row = np.searchsorted(batch.stop, start)
    return row, start - batch.start[row], stop - batch.start[row]


def split_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(id_col, start_pos, end_pos[, sentence]); no shuffle."""
    picked = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("row_id"), F.col(text_col).cast("string").alias("text"))
    kind = picked.schema["row_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = batch.column("text"), batch.column("row_id")
            for lo, hi in blocks(texts):
                row, start, stop = spans(texts.slice(lo, hi - lo))
                columns = [ids.take(pa.array(row + lo)), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))]
                if with_text:
                    own = texts.slice(lo, hi - lo).to_pylist()
                    columns.append(pa.array([own[r][a:b] for r, a, b in zip(row.tolist(), start.tolist(), stop.tolist())], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "start_pos", "end_pos", "sentence"][: len(columns)])

    return picked.mapInArrow(work, f"`{id_col}` {kind}, start_pos int, end_pos int" + (", sentence string" if with_text else ""))
