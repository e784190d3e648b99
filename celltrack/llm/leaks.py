"""Held-out passages that stand in a training corpus.

Texts become streams of letters and digits (case, accents, punctuation, spaces, hyphens, character codes and double
encodings evened out). Every shard of documents gets a suffix array over the word starts of its streams; every
suffix of every test item is looked up in it by binary search, and each match is drawn out to the longest verbatim
stretch on both sides. Stretches are then extended over slips of the pen and over interruptions to the longest run of
the item's words, and a document is affected from ``MIN_WORDS`` consecutive words on.

The test items are the stated query set, searched against all documents. They travel with the tasks in blocks of
at most ``ITEM_BYTES`` of text, one pass over the corpus for each block. All of a shard's matches are drawn out side by
side in arrays; only pairs whose stretches together could hold ``MIN_WORDS`` words are extended one by one.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 18
SEED = 8  # letters a verbatim match from a word start needs
DEPTH = 12  # letters to which suffixes are sorted: one 64-bit number each
REJOIN = 12  # letters that must follow an interruption
INTERRUPTION = 700  # letters an interruption may have
SETTLE = 5  # letters that must follow a slip
RUN_ON = 20  # letters of a word from which on it counts as several run together
SHORT_WORD = 3  # letters from which on a run's outermost word may hold a slip near its end
SHARD_LETTERS = 1 << 20
ITEM_BYTES = 4 << 20
MATCHES_AT_ONCE = 1 << 19
ROUNDS = 3  # slips followed side by side before a stretch counts as possibly long

# Letters that decompose to no plain letter.
PLAIN = str.maketrans({"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i", "ſ": "s"})
# Letters of other scripts that look like Latin ones.
LOOKALIKE = str.maketrans("авеёкмнорстухіїјѕԁɡɑαεηικνορτυχωγ", "abeekmhopctyxiijsdgaaenikvoptuxwy")
TWICE = re.compile("[Â-ô][\u0080-¿ŒœŠšŸŽžƒˆ˜–-™]{1,3}")
DIGIT_IN_WORD = re.compile(r"(?<=[a-z])[013457](?=[a-z])")
LETTER_FOR_DIGIT = str.maketrans("013457", "oleast")
DIGIT_AS = np.arange(256, dtype=np.uint8)
DIGIT_AS[[ord(x) for x in "013457"]] = [ord(x) for x in "oleast"]
ESCAPED = re.compile(r"\\u([0-9a-fA-F]{4})")


def _once(m: re.Match) -> str:
    for code in ("cp1252", "latin-1"):
        try:
            return m[0].encode(code).decode("utf-8")
        except UnicodeError:
            continue
    return m[0]


def even(text: str) -> str:
    """Lower-case text of plain letters and digits, anything else a space."""
    if "&" in text:
        text = html.unescape(text)
    if "\\u" in text:
        text = ESCAPED.sub(lambda m: chr(int(m[1], 16)), text)
    if not text.isascii():
        text = TWICE.sub(_once, text)
        text = unicodedata.normalize("NFKD", text.lower().translate(PLAIN).translate(LOOKALIKE))
        text = "".join(c for c in text if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
    text = DIGIT_IN_WORD.sub(lambda m: m[0].translate(LETTER_FOR_DIGIT), text.lower())
    return re.sub(r"[^a-z0-9\s]", "\x00", text)


BREAK = "\n\x02\n"
ONE_LETTER = {k: v for k, v in (PLAIN | LOOKALIKE).items() if not isinstance(v, str) or len(v) == 1}
SEVERAL = {chr(k): v for k, v in PLAIN.items() if isinstance(v, str) and len(v) > 1}
CODE = np.zeros(256, np.uint64)  # letters and digits as 1 to 36
CODE[97:123] = np.arange(1, 27)
CODE[48:58] = np.arange(27, 37)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def streams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of many texts, where each text begins, and where words start; ``even`` for a whole shard at once.

    ``DEPTH`` zeros or more follow every text. In a word of more than ``RUN_ON`` letters spaces were lost, so every place
    in it may start one.
    """
    text = BREAK.join(t.replace("\x02", " ") if "\x02" in t else t for t in texts)
    if "&" in text:
        text = html.unescape(text)
    if "\\u" in text:
        text = ESCAPED.sub(lambda m: " " if int(m[1], 16) == 2 else chr(int(m[1], 16)), text)
    if text.isascii():
        codes = _codes(text.lower())
    else:
        text = TWICE.sub(_once, text).lower()
        for a, b in SEVERAL.items():
            text = text.replace(a, b)
        codes = _codes(text).copy()
        odd = np.flatnonzero(codes > 127)
        kinds, which = np.unique(codes[odd], return_inverse=True)
        plain = np.array([ord(x) if isinstance(x := ONE_LETTER.get(k, k), str) else x for k in kinds.tolist()], np.uint32)
        codes[odd] = plain[which]
        codes = _codes(unicodedata.normalize("NFKD", codes.tobytes().decode("utf-32-le", "surrogatepass")).lower())
        odd = np.flatnonzero(codes > 127)
        kinds, which = np.unique(codes[odd], return_inverse=True)
        silent = np.array([bool(unicodedata.combining(chr(k))) or unicodedata.category(chr(k)) == "Cf" for k in kinds.tolist()], bool)
        if silent.any():
            stay = np.ones(len(codes), bool)
            stay[odd[silent[which]]] = False
            codes = codes[stay]
    c = np.where(codes < 256, codes, 0).astype(np.uint8)
    letter = (c >= 97) & (c <= 122)
    digit = (c >= 48) & (c <= 57)
    between = np.zeros(len(c), bool)
    between[1:-1] = digit[1:-1] & letter[:-2] & letter[2:]
    at = np.flatnonzero(between)
    c[at] = DIGIT_AS[c[at]]
    keep = letter | digit
    begins = np.flatnonzero(keep & ~np.r_[False, keep[:-1]])
    text_no = np.cumsum(c == 2)
    place = np.cumsum(keep) - keep + DEPTH * text_no
    out = np.zeros(int(keep.sum()) + DEPTH * (len(texts) + 1), np.uint8)
    out[place[keep]] = c[keep]
    begin = np.r_[0, place[c == 2]]
    starts = place[begins]
    after = np.flatnonzero(np.r_[~keep, True] & np.r_[False, keep])
    length = after - begins
    long = np.flatnonzero(length > RUN_ON)
    if len(long):
        every = np.concatenate([np.arange(s, s + n) for s, n in zip(starts[long].tolist(), length[long].tolist())])
        starts = np.union1d(starts, every)
    return out, begin, starts


def item_words(text: str) -> tuple[str, np.ndarray]:
    """Stream of an item and its word ends; words are what white space separates."""
    words = ["".join(c for c in w if c.isalnum()) for w in even(text).replace("\x00", "").split()]
    words = [w for w in words if w]
    return "".join(words), np.cumsum([0, *map(len, words)])


def _common(a: str, i: int, b: str, j: int) -> int:
    """Length of the common run of a[i:] and b[j:]."""
    n = min(len(a) - i, len(b) - j)
    done = 0
    while done < n:
        step = min(64, n - done)
        if a[i + done : i + done + step] == b[j + done : j + done + step]:
            done += step
            continue
        while a[i + done] == b[j + done]:
            done += 1
        return done
    return done


SLIPS = ((1, 1), (0, 1), (1, 0), (2, 2), (1, 2), (2, 1), (0, 2), (2, 0))


def _may_slip(x: str, y: str, a: str, i: int) -> bool:
    """Letters may be mistyped freely; of a number of three or more digits one digit, or two that change places."""
    if not any(c.isdigit() for c in x + y):
        return True
    if not all(c.isdigit() for c in x + y) or not (len(x) + len(y) <= 2 or x == y[::-1]):
        return False
    lo, hi = i, i
    while lo and a[lo - 1].isdigit():
        lo -= 1
    while hi < len(a) and a[hi].isdigit():
        hi += 1
    return hi - lo >= 3


def extend(a: str, starts: list[int], i: int, b: str, j: int, edges: set[int], rejoin: bool = True) -> tuple[int, int]:
    """How far a[i:] goes on in b[j:], over slips inside words and interruptions between them: the places reached.

    ``edges`` are the places of b between two words. A slip must be followed by ``SETTLE`` equal letters, or by
    the rest of a word that ends in both texts, where one letter differs or two are swapped, and the word has
    ``SHORT_WORD`` or more letters or three equal ones after it.
    """
    slips_at = -1
    slips = 0
    while True:
        n = _common(a, i, b, j)
        i, j = i + n, j + n
        if i >= len(a):
            return i, j
        word = bisect_right(starts, i) - 1
        if word != slips_at:
            slips_at, slips = word, 0
        ahead = ""
        begin = starts[word]
        end = starts[word + 1] if word + 1 < len(starts) else len(a)
        if slips < 2:
            for da, db in SLIPS:
                settled = a[i + da : i + da + SETTLE]
                if settled and b.startswith(settled, j + db) and _may_slip(a[i : i + da], b[j : j + db], a, i):
                    ahead = settled
                    break
            else:
                long = end - begin >= SHORT_WORD and i > begin
                after = a[end : end + 3]
                for da, db in SLIPS[:4]:
                    to = j + db + end - i - da
                    swap = da < 2 or a[i : i + 2] == b[j : j + 2][::-1]
                    if swap and i + da < end and to in edges and b.startswith(a[i + da : end], j + db) and (long or len(after) == 3 and b.startswith(after, to)) and _may_slip(a[i : i + da], b[j : j + db], a, i):
                        ahead = "."
                        break
            if ahead:
                i, j, slips = i + da, j + db, slips + 1
            if ahead:
                continue
        key = a[begin : begin + REJOIN]
        at = b.find(key, max(0, j - (i - begin)), j + INTERRUPTION) if rejoin and len(key) >= min(REJOIN, 6) else -1
        if at < 0 or at == j - (i - begin):
            return (begin, j - (i - begin)) if i > begin else (i, j)
        i, j = begin, at
        slips_at, slips = -1, 0


def longest_run(item: str, ends: np.ndarray, doc: str, edges: np.ndarray, stretches: list[tuple[int, int]]) -> tuple[int, int]:
    """``(words, first word)`` of the longest run of whole item words that the verbatim stretches lead to."""
    starts, back_starts = ends[:-1].tolist(), (len(item) - ends[::-1])[:-1].tolist()
    back_item, ends = item[::-1], ends.tolist()
    back_doc, ahead_edges, back_edges = doc[::-1], set(edges.tolist()), set((len(doc) - edges).tolist())
    best, first = 0, 0
    covered: list[tuple[int, int, int, int]] = []
    for p, q in stretches:
        if any(a <= p < b and c <= q < d for a, b, c, d in covered):
            continue
        for rejoin in (False, True):
            right, q_right = extend(item, starts, p, doc, q, ahead_edges, rejoin)
            left, q_left = (len(item), len(doc) - q) if not p else extend(back_item, back_starts, len(item) - p, back_doc, len(doc) - q, back_edges, rejoin)
            left, q_left = len(item) - left, len(doc) - q_left
            lo, hi = bisect_left(ends, left), bisect_right(ends, right) - 1
            if hi <= lo or ends[hi] - ends[lo] < REJOIN:  # too little to go on from beyond an interruption
                break
        covered.append((left, right, q_left, q_right))
        if hi - lo > best:
            best, first = hi - lo, lo
    return best, first


def word_keys(letters: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The ``DEPTH`` letters from each place as one number; order of numbers is order of suffixes."""
    key = np.zeros(len(at), np.uint64)
    for k in range(DEPTH):
        key = key * np.uint64(37) + CODE[letters[at + k]]
    return key


class SuffixShard:
    """Suffix array, to ``DEPTH`` letters, over the word starts of a few streams."""

    def __init__(self, letters: np.ndarray, starts: np.ndarray):
        key = word_keys(letters, starts)
        order = np.argsort(key)
        self.key, self.place = key[order], starts[order]

    def find(self, prefixes: np.ndarray, length: int = SEED) -> tuple[np.ndarray, np.ndarray]:
        """First and last place in the array of the suffixes that begin with each prefix of ``length`` letters."""
        rest = np.uint64(37 ** (DEPTH - length))
        return np.searchsorted(self.key, prefixes, "left"), np.searchsorted(self.key, prefixes + rest, "left")


class Items:
    """The test items of one block, ready to be looked up."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.id = [i for i, _ in rows]
        self.text, self.ends = zip(*(item_words(t) for _, t in rows)) if rows else ((), ())
        length = np.array([len(t) for t in self.text], np.int64)
        self.begin = np.cumsum(np.r_[0, length[:-1] + DEPTH]) if rows else np.zeros(0, np.int64)
        self.end = self.begin + length
        gap = "\0" * DEPTH
        self.letters = np.frombuffer((gap.join(self.text) + gap).encode(), np.uint8)
        words = [e[:-1] + b for e, b in zip(self.ends, self.begin)]
        self.start = np.concatenate(words) if words else np.zeros(0, np.int64)  # of every word
        item = np.repeat(np.arange(len(rows)), [len(w) for w in words])
        use = self.start + SEED <= (self.begin + length)[item] if rows else np.zeros(0, bool)
        self.item, self.at = item[use], self.start[use]
        rest = np.uint64(37 ** (DEPTH - SEED))
        self.prefix = word_keys(self.letters, self.at) // rest * rest


def _stretch(a: np.ndarray, p: np.ndarray, b: np.ndarray, q: np.ndarray, step: int, wide: int = 16) -> np.ndarray:
    """Equal letters from a[p] and b[q] on, in direction ``step``; both arrays are padded by ``wide`` or more zeros."""
    n = np.zeros(len(p), np.int64)
    live = np.arange(len(p))
    ahead = np.arange(wide) * step
    while len(live):
        x, y = a[(p[live] + n[live] * step)[:, None] + ahead], b[(q[live] + n[live] * step)[:, None] + ahead]
        bad = (x != y) | (x == 0)
        k = np.where(bad.any(1), bad.argmax(1), wide)
        n[live] += k
        live = live[k == wide]
    return n


def _over_slips(a: np.ndarray, p: np.ndarray, b: np.ndarray, q: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """The place of a reached from p over slips alone, and which are still going after ``ROUNDS`` slips."""
    p, q = p.copy(), q.copy()
    live = np.arange(len(p))
    settle = np.arange(SETTLE) * step
    for _ in range(ROUNDS):
        go = np.zeros(len(live), bool)
        da_, db_ = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
        for da, db in SLIPS:
            i, j = p[live] + da * step, q[live] + db * step
            some = np.flatnonzero((a[i] == b[j]) & (a[i] != 0) & ~go)
            x, y = a[i[some, None] + settle], b[j[some, None] + settle]
            some = some[((x == y) & (x != 0)).all(1)]
            da_[some], db_[some], go[some] = da, db, True
        live, da_, db_ = live[go], da_[go], db_[go]
        if not len(live):
            break
        p[live] += da_ * step
        q[live] += db_ * step
        n = _stretch(a, p[live], b, q[live], step)
        p[live] += n * step
        q[live] += n * step
    return p, live


PAD = 64


def _matches(items: Items, shard: SuffixShard, letters: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Longest verbatim stretches ``(item, p, q, length)``, p and q places in all items' and the shard's letters."""
    lo, hi = shard.find(items.prefix)
    total = np.cumsum(hi - lo)
    a, b = np.pad(items.letters, PAD), np.pad(letters, PAD)
    at = 0
    while at < len(lo):
        # whole items at once, so that a document's stretches of one item stay together
        to = int(np.searchsorted(total, (total[at - 1] if at else 0) + MATCHES_AT_ONCE, "right"))
        to = max(to, int(np.searchsorted(items.item, items.item[at], "right")))
        if to < len(lo):
            to = max(int(np.searchsorted(items.item, items.item[to], "left")), int(np.searchsorted(items.item, items.item[at], "right")))
        n = (hi - lo)[at:to]
        if n.sum():
            kept: list[np.ndarray] = []
            low = np.repeat(lo[at:to], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            word = np.repeat(np.arange(at, to), n)
            for k in range(0, len(low), MATCHES_AT_ONCE):
                w, q = word[k : k + MATCHES_AT_ONCE], shard.place[low[k : k + MATCHES_AT_ONCE]]
                p = items.at[w]
                ahead = _stretch(a, p + (PAD + SEED), b, q + (PAD + SEED), 1) + SEED
                back = _stretch(a, p + (PAD - 1), b, q + (PAD - 1), -1)
                kept.append(np.column_stack([p - back, q - back, items.item[w], ahead + back]))
            all_ = np.concatenate(kept)
            _, one = np.unique(all_[:, 0] * np.int64(len(letters) + 1) + all_[:, 1], return_index=True)
            p, q, item, length = all_[one].T
            yield item, p, q, length
        at = to


def _abutting(group: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longest union of intervals of each group that overlap or lie one apart at most; sorted by group and begin."""
    if not len(group):
        return group, begin
    big = np.int64(4 * (int(end.max()) + 1))
    reach = np.maximum.accumulate(end + group * big) - group * big
    new = np.r_[True, (group[1:] != group[:-1]) | (begin[1:] > reach[:-1] + 1)]
    first = np.flatnonzero(new)
    size = reach[np.r_[first[1:], len(group)] - 1] - begin[first]
    of = group[first]
    start = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    return of[start], np.maximum.reduceat(size, start)


def _search(items: Items, ids: list[int], texts: list[str]) -> list[tuple[int, int, int, int, int, int]]:
    """``(item_id, doc_id, n_words, first_word, longest, place)`` of one shard of documents."""
    letters, begin, starts = streams(texts)
    shard = SuffixShard(letters, starts)
    a, b = np.pad(items.letters, PAD), np.pad(letters, PAD)
    out = []
    for item, p, q, length in _matches(items, shard, letters):
        doc = np.searchsorted(begin, q, "right") - 1
        right, on_r = _over_slips(a, p + length + PAD, b, q + length + PAD, 1)
        left, on_l = _over_slips(a, p + (PAD - 1), b, q + (PAD - 1), -1)
        moves = (length >= REJOIN) | (right > p + length + PAD) | (left < p + (PAD - 1))
        far = np.zeros(len(p), bool)
        far[on_r] = far[on_l] = True
        # the most words that a pair's stretches could cover in one run: beyond an interruption it goes on with the next
        # whole word, at a stretch of REJOIN letters, so such stretches must abut in the item; of shorter ones it can
        # hold one; its outermost words may be cut
        w0 = np.searchsorted(items.start, left - PAD + 1, "left")
        w1 = np.maximum(w0, np.searchsorted(items.start, right - PAD, "right") - (right - PAD < items.end[item]))
        w1[far] = w0[far] + MIN_WORDS
        order = np.lexsort((w0, doc * np.int64(len(items.id)) + item))
        pair = (doc * np.int64(len(items.id)) + item)[order]
        new = np.r_[True, pair[1:] != pair[:-1]]
        number = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(order)]
        join = length[order] >= REJOIN
        words = np.maximum.reduceat(np.where(join, 0, (w1 - w0)[order]), first)
        abut = _abutting(number[join], w0[order][join], w1[order][join])
        words += np.bincount(abut[0], abut[1], len(first)).astype(words.dtype)
        for k in np.flatnonzero(words >= MIN_WORDS - 2):
            some = order[first[k] : last[k]]
            i, d = int(item[some[0]]), int(doc[some[0]])
            end = int(begin[d + 1]) - DEPTH if d + 1 < len(begin) else len(letters) - 2 * DEPTH
            text = letters[begin[d] : end].tobytes().decode("ascii")
            edges = np.r_[starts[np.searchsorted(starts, begin[d]) : np.searchsorted(starts, end)] - begin[d], len(text)]
            some = some[np.argsort(-length[some], kind="stable")]
            some = np.r_[some[:1], some[1:][moves[some[1:]]]]  # the others lead nowhere
            n, at = longest_run(items.text[i], items.ends[i], text, edges, list(zip((p[some] - items.begin[i]).tolist(), (q[some] - begin[d]).tolist())))
            if n >= MIN_WORDS:
                out.append((items.id[i], ids[d], n, at, int(length[some[0]]), int(q[some[0]] - begin[d])))
    return out


RESULT = ["item_id", "doc_id", "n_words", "first_word", "longest", "place"]


def find_leaks(docs: DataFrame, items: DataFrame, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """``(item_id, doc_id, n_words, first_word, longest, place)``: documents that hold ``MIN_WORDS`` or more words of an item.

    n_words is the length of the longest run, first_word where in the item it begins (from 0); longest is the length
    of the longest verbatim match in letters and digits, place where in those of the document it lies. Null or empty
    texts and null ids match nothing; repeated rows give one row. Copies of a document are each reported. No items or no
    documents give no rows.
    """
    spark = docs.sparkSession
    asked = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").filter("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    size = asked.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(size) // item_bytes))
    corpus = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    found: DataFrame | None = None
    for block in range(blocks):
        part = [(r["item_id"], r["text"]) for r in asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).toLocalIterator()]
        sent = spark.sparkContext.broadcast(part)

        def look(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            ready = Items(sent.value)
            if not len(ready.prefix):
                return
            ids, texts, size = [], [], 0
            for b in batches:
                for d, t in zip(b["doc_id"].tolist(), b["text"]):
                    ids.append(d), texts.append(t)
                    size += len(t)
                    if size >= SHARD_LETTERS:
                        yield pd.DataFrame(_search(ready, ids, texts), columns=RESULT)
                        ids, texts, size = [], [], 0
            if ids:
                yield pd.DataFrame(_search(ready, ids, texts), columns=RESULT)

        hits = corpus.mapInPandas(look, "item_id bigint, doc_id bigint, n_words int, first_word int, longest int, place bigint")
        found = hits if found is None else found.unionByName(hits)
    best = F.max_by(F.struct(*RESULT[2:]), F.struct("n_words", "longest", -F.col("first_word"), -F.col("place")))
    return found.groupBy("item_id", "doc_id").agg(best.alias("b")).select("item_id", "doc_id", "b.*")


def without_leaks(docs: DataFrame, leaks: DataFrame) -> DataFrame:
    """The documents that no leak names."""
    return docs.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti")
