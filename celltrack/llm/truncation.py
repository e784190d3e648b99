"""Texts that lost their end.

A backward character n-gram model: for the last 3, 6, 12 and 24 characters of a text (digits
folded to one, case and spacing evened) it compares how often that context ends a text with how often
it occurs at all, in every text of the corpus, backing off from long contexts to short ones. A text is cut
where the log-odds of an end, against the language's rate of ends for each character, stay below
``THRESHOLD``. Marks of omission are taken off first. Ends that are no words are decided by their form:
a cut character code or an open bracket is a cut; a dash (broken off by another speaker) and a signature line of name and place are whole.
Other lines that begin with a dash, such as interjections, are judged by their end like any text.

Only contexts that some text ends with are counted. They are recognised while scanning by a bit map, sized by the
number of contexts up to ``MOST_BITS`` (32 MB), which lets a few others through, more of them when it is full; the join
with the contexts is exact. Tasks give out their counts whenever they hold ``HELD_AT_ONCE`` of them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from celltrack.runtime import cut

ORDERS = (3, 6, 12, 24)
SENTENCE_ORDER = 6
LEAST_BITS, MOST_BITS, BITS_A_CONTEXT = 1 << 20, 1 << 28, 16
THRESHOLD = 0.8  # decimal log-odds over the language's rate
SENTENCE_THRESHOLD = -0.7
BACKOFF = 3.0
FIRST_GUESS = 0.01
CHARS_AT_ONCE = 1 << 20
HELD_AT_ONCE = 1 << 21  # counts a task keeps before it gives them out
WITNESS = 80
TAIL = 200
BASE = np.uint64(0x9E3779B97F4A7C15)

OMISSION = re.compile(r"(?:\s*(?:\.{2,}|…|\[\s*(?:\.{3}|…)\s*\]|\(\s*(?:\.{3}|…)\s*\)))+\s*$")
CARRY_ON = re.compile(r"(?<=[\w,;:])\s+[(\[]\s*[a-zà-ÿ][a-zà-ÿ.'’ ]{0,14}[)\]]?\s*$")  # [more], (cont.), (suite)
SENTENCE = re.compile(r"[.!?][)\]»”\"'’›“]*$")
DASH = re.compile(r"[—–―-]$")
_NAME = r"[A-ZÀ-ÖØ-Þ][\w.'’-]*"
SIGNATURE = re.compile(rf"(?:^|\n)\s*[—–―]\s+{_NAME}(?:\s+[\w.'’-]+){{0,4}},\s+(?:(?:the|der|die|das|le|la|les|el|los|las)\s+|l['’])?{_NAME}(?:\s+[\w.'’-]+){{0,4}}$")  # dash, name, place
# Character codes that appear in texts.
ENTITIES = "quot nbsp amp lt gt apos mdash ndash hellip laquo raquo lsquo rsquo ldquo rdquo eacute egrave ecirc agrave acirc ccedil auml ouml uuml Auml Ouml Uuml szlig ntilde iacute oacute aacute uacute shy".split()
CODE = re.compile(
    r"(?:&|&#x?[0-9a-fA-F]{0,6}|&(?:" + "|".join(sorted({re.escape(e[:n]) for e in ENTITIES for n in range(2, len(e) + 1)} | {e[0] for e in ENTITIES if e[0].islower()}, key=len, reverse=True)) + r")|\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?|�)$"
)
PAIRS = {")": "(", "]": "["}


ASIDE = re.compile(r"\s*(?:\([^()\[\]\n]{1,80}\)|\[[^()\[\]\n]{1,80}\])$")


def strip_asides(text: str) -> str:
    """Without whole bracketed remarks at the end, unless nothing would be left."""
    while (m := ASIDE.search(text[-120:])) and len(text) > len(m[0]):
        rest = text[: -len(m[0])].rstrip()
        if not rest or not re.search(r"[.!?—–\-)\]»”\"\'’]$|\n\s*$", text[: -len(m[0])] + (m[0][:1] if m[0][:1] == "\n" else "")):
            break
        text = rest
    return text


def fold(text: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"\d+", "0", text.lower()))


def strip_omission(text: str) -> str:
    """Without marks of omission at the end; only the last characters are looked at, more where nothing of them is left."""
    text = text.rstrip()
    while text:
        tail = text[-TAIL:]
        left = OMISSION.sub("", CARRY_ON.sub("", tail)).rstrip()
        if left == tail:
            break
        text = text[: len(text) - len(tail)] + left
        if left:
            break
        text = text.rstrip()
    return text


def _open_bracket(line: str) -> bool:
    stack: list[str] = []
    for ch in line:
        if ch in "([":
            stack.append(ch)
        elif ch in PAIRS and stack and stack[-1] == PAIRS[ch]:
            stack.pop()
    return bool(stack)


def form_of_end(text: str) -> str:
    """code, bracket, dash, signature, sentence or word, for a text without its omission mark."""
    if CODE.search(text[-12:]):
        return "code"
    last = text[text.rfind("\n", -400) + 1 :][-400:]
    if ("(" in last or "[" in last) and _open_bracket(last):
        return "bracket"
    if SIGNATURE.search(text[-120:]):
        return "signature"
    if DASH.search(text[-1:]):
        return "dash"
    return "sentence" if SENTENCE.search(text[-12:]) else "word"


def hash_text(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


BREAK = "\x02"
_IS_DIGIT = np.array([chr(c).isdecimal() for c in range(256)])
_IS_SPACE = np.array([bool(re.match(r"\s", chr(c))) for c in range(256)])


def _kinds(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which codes are digits and which white space, as the patterns of ``fold`` have it."""
    low = np.minimum(codes, 255).astype(np.uint8)
    digit, space = _IS_DIGIT[low], _IS_SPACE[low]
    odd = np.flatnonzero(codes > 254)
    if len(odd):
        kinds, which = np.unique(codes[odd], return_inverse=True)
        digit[odd] = np.array([chr(k).isdecimal() for k in kinds.tolist()])[which]
        space[odd] = np.array([bool(re.match(r"\s", chr(k))) for k in kinds.tolist()])[which]
    return digit, space


def folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``fold`` of many texts at once: their characters behind one another, and how many of its text lie before each."""
    codes = _codes(BREAK.join(t.replace(BREAK, " ") if BREAK in t else t for t in texts).lower())
    digit, space = _kinds(codes)
    stay = np.ones(len(codes), bool)
    stay[1:] = ~(digit[1:] & digit[:-1] | space[1:] & space[:-1])
    codes = np.where(digit, 48, np.where(space, 32, codes))[stay].astype(np.uint32)
    at = np.arange(len(codes))
    ends = np.flatnonzero(codes == ord(BREAK))
    start = np.r_[0, ends + 1]
    return codes, at - np.repeat(start, np.diff(np.r_[start, len(codes)]))


def _mixed(h: np.ndarray) -> np.ndarray:
    return h ^ (h >> np.uint64(29))


class Contexts:
    """Hashes of the last 3, 6, 12 and 24 characters at any place of ``folded`` texts."""

    def __init__(self, codes: np.ndarray):
        with np.errstate(over="ignore"):
            c = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
            self.h = {3: c.copy()}
            self.h[3][1:] += BASE * c[:-1]
            self.h[3][2:] += self._power(2) * c[:-2]
            self.h[6] = self.h[3].copy()
            self.h[6][3:] += self._power(3) * self.h[3][:-3]

    @staticmethod
    def _power(n: int) -> np.uint64:
        return np.uint64(pow(int(BASE), n, 1 << 64))

    def _raw(self, n: int, at: np.ndarray) -> np.ndarray:
        if n in self.h:
            return self.h[n][at]
        return self._raw(n // 2, at) + self._power(n // 2) * self._raw(n // 2, at - n // 2)

    def hashes(self, n: int, at: np.ndarray) -> np.ndarray:
        """At places that have n characters of their text up to them."""
        with np.errstate(over="ignore"):
            return _mixed(self._raw(n, at))

    def every(self, n: int) -> np.ndarray:
        return _mixed(self.h[n])


def slots_for(contexts: int) -> int:
    """Size of the bit map: a power of two."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_A_CONTEXT * int(contexts)).bit_length()))


def language(c: Column) -> Column:
    code = F.lower(F.trim(c))
    return F.when(code.rlike("^[a-z]{2}$"), code).otherwise("und")


def scored_ends(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", keep: tuple[str, ...] = (), thresholds: dict[str, float] | None = None) -> DataFrame:
    """``key, *keep, language, form, log_odds, truncated`` for every row of one column of texts.

    The log-odds are over the language's own rate of ends in that column, so one threshold serves; ``thresholds`` sets
    others for some languages.

    Null and empty texts are whole, with null form and log_odds. Repeated rows are judged one by one and alike.
    Rows with a null key are left out. Columns of any other name are ignored.
    """
    spark = docs.sparkSession
    base = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), language(F.col(lang)).alias("language"), F.col(text).alias("text"))

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, tails = [], []
            for i, lang_, t in zip(b["id"].tolist(), b["language"].tolist(), b["text"].tolist()):
                t = strip_asides(strip_omission(t or ""))
                if not t:
                    continue
                tail = fold(t[-TAIL:])
                rows.append((i, lang_, form_of_end(t), len(t), hash_text(tail[-WITNESS:])))
                tails.append(tail[-ORDERS[-1] :])
            if not rows:
                continue
            out = pd.DataFrame(dict(zip(("id", "language", "form", "chars", "witness"), zip(*rows))))
            length = np.array([len(t) for t in tails])
            last = np.cumsum(length) - 1
            ctx = Contexts(_codes("".join(tails)))
            form = out["form"].to_numpy()
            for n in ORDERS:
                has = (length >= n) & ((form == "word") | ((form == "sentence") & (n == SENTENCE_ORDER)))
                h = np.zeros(len(rows), np.int64)
                h[has] = ctx.hashes(n, last[has]).view(np.int64)
                out[f"h{n}"] = pd.arrays.IntegerArray(h, ~has)
            yield out

    schema = "id bigint, language string, form string, chars bigint, witness bigint, " + ", ".join(f"h{n} bigint" for n in ORDERS)
    tails = cut(base.mapInPandas(ends, schema))
    contexts = tails.select("witness", F.explode(F.array(*(F.struct(F.lit(n).alias("n"), F.col(f"h{n}").alias("h")) for n in ORDERS))).alias("c")).select("witness", "c.*").filter("h IS NOT NULL")
    n_end = contexts.groupBy("n", "h").agg(F.count_distinct("witness").alias("n_end"))  # copies of one text are one witness
    bits = slots_for(contexts.select(F.approx_count_distinct(F.xxhash64("n", "h"), 0.05)).first()[0])
    slot = F.pmod(F.col("h"), F.lit(bits))  # a power of two: the low bits, signed or not
    chunks = (
        contexts.select((slot + 1).alias("s"))
        .groupBy(F.bitmap_bucket_number("s").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits"))
        .toLocalIterator()  # at most bits / 32768 rows of 4 KB
    )
    seen = np.zeros(bits // 8, np.uint8)
    for r in chunks:
        at = (r["bucket"] - 1) * 4096
        seen[at : at + 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)[: len(seen) - at]
    sent = spark.sparkContext.broadcast(seen)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = sent.value
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {n: [] for n in ORDERS}

        def hit(h: np.ndarray) -> np.ndarray:
            at = h & np.uint64(bits - 1)
            return (known[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0

        def add(texts: list[str], skip: int = 0) -> int:
            """Count the contexts that end beyond the first ``skip`` characters; how many entries are held now."""
            codes, inside = folded(texts)
            ctx = Contexts(codes)
            ends_at: np.ndarray | None = None
            for n in ORDERS:
                if n <= SENTENCE_ORDER:
                    own = inside >= max(n - 1, skip)
                    at = np.flatnonzero(own & hit(ctx.every(n)))
                    h = ctx.hashes(n, at)
                else:  # whatever ends with n characters ends with the shorter ones
                    at = ends_at[inside[ends_at] >= n - 1]
                    h = ctx.hashes(n, at)
                    ok = hit(h)
                    at, h = at[ok], h[ok]
                ends_at = at
                if len(h):
                    held[n].append(np.unique(h.view(np.int64), return_counts=True))
            return sum(len(h) for parts in held.values() for h, _ in parts)

        def flush() -> Iterator[pd.DataFrame]:
            for n, parts in held.items():
                if parts:
                    h, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                    total = np.bincount(back, np.concatenate([p[1] for p in parts])).astype(np.int64)
                    yield pd.DataFrame({"n": np.full(len(h), n, np.int32), "h": h, "n_all": total})
                    parts.clear()

        waiting, size = [], 0
        for b in batches:
            for t in b["text"].tolist():
                t = strip_omission(t or "")
                skip = 0
                if len(t) > CHARS_AT_ONCE:
                    t = fold(t)
                while len(t) > CHARS_AT_ONCE:  # a very long text goes in pieces that overlap by one context
                    if add([t[:CHARS_AT_ONCE]], skip) > HELD_AT_ONCE:
                        yield from flush()
                    t, skip = t[CHARS_AT_ONCE - ORDERS[-1] + 1 :], ORDERS[-1] - 1
                if skip:
                    add([t], skip)
                    continue
                waiting.append(t)
                size += len(t)
                if size >= CHARS_AT_ONCE:
                    if add(waiting) > HELD_AT_ONCE:
                        yield from flush()
                    waiting, size = [], 0
        if waiting:
            add(waiting)
        yield from flush()

    n_all = base.select("text").mapInPandas(count, "n int, h bigint, n_all bigint").groupBy("n", "h").agg(F.sum("n_all").alias("n_all"))
    counts = cut(n_end.join(n_all, ["n", "h"], "left").select("n", "h", "n_end", F.coalesce("n_all", "n_end").alias("n_all")))
    long = tails.select("id", "form", F.posexplode(F.array(*(F.struct(F.lit(n).alias("n"), F.col(f"h{n}").alias("h")) for n in ORDERS))).alias("k", "c")).select("id", "c.n", "c.h").filter("h IS NOT NULL").distinct()
    wide = long.join(counts, ["n", "h"]).groupBy("id").agg(*(x for n in ORDERS for x in (F.max(F.when(F.col("n") == n, F.col("n_end"))).alias(f"e{n}"), F.max(F.when(F.col("n") == n, F.col("n_all"))).alias(f"a{n}"))))
    p: Column = F.lit(FIRST_GUESS)
    for n in ORDERS:  # an end does not speak for itself: one is taken off
        e, a = F.col(f"e{n}") - 1, F.greatest(F.col(f"a{n}"), F.col(f"e{n}")) - 1
        p = F.when(e.isNull(), p).otherwise((e + BACKOFF * p) / (a + BACKOFF))
    rate = tails.groupBy("language").agg((F.count(F.lit(1)) / F.sum("chars")).alias("rate"))
    odds = lambda x: F.log10(x / (1 - x))
    judged = tails.select("id", "language", "form").join(wide, "id", "left").join(rate, "language").withColumn("p", F.least(p, F.lit(0.999)))
    judged = judged.withColumn("log_odds", F.when(F.col("form").isin("word", "sentence"), odds(F.col("p")) - odds(F.least(F.col("rate"), F.lit(0.5)))))
    word_limit = F.lit(THRESHOLD)
    for name, least in (thresholds or {}).items():
        word_limit = F.when(F.col("language") == name, F.lit(float(least))).otherwise(word_limit)
    limit = F.when(F.col("form") == "sentence", F.lit(SENTENCE_THRESHOLD)).otherwise(word_limit)
    cut_off = F.col("form").isin("code", "bracket") | F.coalesce(F.col("log_odds") < limit, F.lit(False))
    verdict = judged.select(F.col("id").alias(key), "form", "log_odds", cut_off.alias("truncated")).distinct()
    out = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias(key), *(F.col(k) for k in keep), language(F.col(lang)).alias("language"))
    return out.join(verdict, key, "left").withColumn("truncated", F.coalesce("truncated", F.lit(False)))


def source_name(c: Column) -> Column:
    """Sources are spelt unevenly: case, spaces and hyphens fold together; missing is '(none)'."""
    return F.coalesce(F.nullif(F.regexp_replace(F.lower(F.trim(c)), r"[\s\-]+", "_"), F.lit("")), F.lit("(none)"))


def truncation_rates(docs: DataFrame) -> DataFrame:
    """``(source, language, n_docs, n_truncated, share)``: how often each source truncates."""
    s = scored_ends(docs, keep=("source",))
    return s.groupBy(source_name(F.col("source")).alias("source"), "language").agg(
        F.count(F.lit(1)).alias("n_docs"), F.count(F.when(F.col("truncated"), 1)).alias("n_truncated"), F.avg(F.col("truncated").cast("double")).alias("share")
    )
