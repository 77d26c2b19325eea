"""Byte-level BPE over many texts at once: pre-tokens as spans of one byte array, each distinct one encoded once.

The pre-token rules are those of the vocabulary file (contractions, runs of letters, of numbers and of other marks with
one leading space, white space); special strings of the file stand alone. Which characters are letters, numbers or white
space is taken from unicodedata, and asked of the library for code points that unicodedata doesn't know.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable
from functools import cache
from itertools import chain

import numpy as np

from ._words import span_hashes

OTHER, LETTER, NUMBER, SPACE, UNKNOWN = range(5)
#: Distinct pre-tokens (of at most KEPT_BYTES) that a Python worker remembers before it starts anew.
KEPT_PIECES, KEPT_BYTES = 500_000, 64
#: Pre-tokens that the library encodes in one call: its results take about a kilobyte each until they are read.
CALL = 1 << 13
#: Pre-tokens that go to the library as one text where that can't change them.
JOINED = 64
#: First bytes of characters some of which are white space.
_MAYBE_WHITE = np.array([0xC2, 0xE1, 0xE2, 0xE3], np.uint8)
#: A text of more bytes is cut into windows of about that many, where a cut is safe.
LONG = 4 << 20
_CONTRACTIONS = (b"s", b"t", b"m", b"d", b"re", b"ve", b"ll")
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def ragged_take(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """pool[starts[0]:][:lengths[0]], pool[starts[1]:][:lengths[1]], ... in one array."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


def bounds(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def same_bytes(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether each span of a equals that of b of the same length."""
    if len(lengths) and (b_starts[1:] == b_starts[:-1] + lengths[:-1]).all():
        equal = ragged_take(a, a_starts, lengths) == b[b_starts[0] : b_starts[-1] + lengths[-1]]  # one after the other
    else:
        equal = ragged_take(a, a_starts, lengths) == ragged_take(b, b_starts, lengths)
    if equal.all():
        return np.ones(len(lengths), bool)
    wrong = np.zeros(len(equal) + 1, np.int64)
    np.cumsum(~equal, out=wrong[1:])
    at = bounds(lengths)
    return wrong[at[1:]] == wrong[at[:-1]]


class Growing:
    """An array that grows at its end by doubling."""

    def __init__(self, kind: type, columns: int = 0) -> None:
        self.all = np.empty((1 << 14, columns) if columns else 1 << 16, kind)
        self.n = 0

    def add(self, more: np.ndarray) -> int:
        first = self.n
        if first + len(more) > len(self.all):
            wider = np.empty((max(2 * len(self.all), first + len(more)), *self.all.shape[1:]), self.all.dtype)
            wider[:first] = self.all[:first]
            self.all = wider
        self.all[first : first + len(more)] = more
        self.n += len(more)
        return first


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Vocabulary:
    """A tokenizer file for the tokenizers library: byte-level BPE without normalizer, as byte_bpe_50k.json."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec.get("normalizer") or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError(f"{path} isn't plain byte-level BPE")
        # the printable stand-ins of the 256 bytes
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        vocab = spec["model"]["vocab"]
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        words: list[bytes] = [b""] * size
        for word, i in vocab.items():
            words[i] = bytes(byte_of[c] for c in word)
        for word, i in self.special.items():
            words[i] = word
        self.words = words
        self.word_len = np.array([len(w) for w in words], np.int64)
        self.word_at = bounds(self.word_len)[:-1]
        self.word_pool = np.frombuffer(b"".join(words), np.uint8)
        self.byte_id = np.zeros(256, np.int64)
        for c, b in byte_of.items():
            self.byte_id[b] = vocab[c]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left, right = (np.array([vocab[m[i]] for m in merges], np.int64) for i in (0, 1))
        key = left << 32 | right
        order = np.argsort(key, kind="stable")
        self.pair_key, self.pair_rank = key[order], order
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        kinds = np.full(0x110000, UNKNOWN, np.uint8)
        for c in range(0x110000):
            k = unicodedata.category(chr(c))
            kinds[c] = {"L": LETTER, "N": NUMBER}.get(k[0], UNKNOWN if k == "Cn" else OTHER)
        kinds[_WHITE] = SPACE
        self.kinds = kinds

    def windows(self, raw: np.ndarray, offsets: np.ndarray, limit: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
        """Texts as they are, but for a long one by itself: that in windows, cut before a single space between two letters or digits,
        where a pre-token starts whatever stands around. Without such a space a window is longer."""
        limit = limit or LONG
        if len(offsets) != 2 or len(raw) <= 2 * limit or any(b" " in w for w in self.special):
            return [(raw, offsets)]
        cuts, at = [0], limit
        while at < len(raw) - limit:
            part = raw[at - 1 : at + (limit >> 2)]
            plain = _PLAIN[part]
            spots = np.flatnonzero((part[1:-1] == 0x20) & plain[:-2] & plain[2:])
            if len(spots):
                cuts.append(at + int(spots[0]))
                at = cuts[-1] + limit
            else:
                at += (limit >> 2) - 1
        cuts.append(len(raw))
        return [(raw[a:b], np.array([0, b - a])) for a, b in zip(cuts[:-1], cuts[1:])]

    def kind(self, points: np.ndarray) -> np.ndarray:
        got = self.kinds[points]
        if (unknown := got == UNKNOWN).any():
            ask = self.library.pre_tokenizer.pre_tokenize_str
            for c in np.unique(points[unknown]).tolist():
                self.kinds[c] = LETTER if len(ask("a" + chr(c))) == 1 else NUMBER if len(ask("1" + chr(c))) == 1 else OTHER
            got = self.kinds[points]
        return got

    def split(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the pre-tokens in bytes, which of them are special strings (their id, else -1), and which start at a single
        space between two characters that aren't white space: a text can be cut there whatever stands around."""
        whole = raw.tobytes()
        points = np.frombuffer(whole.decode("utf-8").encode("utf-32-le"), np.uint32)
        n = len(points)
        if not n:
            none = np.zeros(0, np.int64)
            return none, none, none, none.astype(bool)
        width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
        at = bounds(width)
        first = np.zeros(n + 1, bool)
        first[np.searchsorted(at, offsets)] = True
        marks = []
        for word, number in self.special.items():
            i = whole.find(word)
            while i >= 0:
                j = i + len(word)
                # a special string that runs over the end of a text is none
                if np.searchsorted(offsets, i, "right") == np.searchsorted(offsets, j, "left"):
                    a, b = np.searchsorted(at, (i, j))
                    marks.append((a, b, number))
                    first[[a, b]] = True
                    i = whole.find(word, j)
                else:
                    i = whole.find(word, i + 1)
        kind = self.kind(points)
        white = kind == SPACE
        blank = points == 32
        start = first[:n].copy()
        start[1:] |= kind[1:] != kind[:-1]
        joined = np.zeros(n, bool)  # the mark before belongs to it
        joined[1:] = blank[:-1] & ~white[1:] & ~first[1:n]
        start &= ~joined
        last = white.copy()
        last[:-1] &= ~white[1:]
        last &= ~first[1:]  # of white space before something else
        start |= last
        quote = np.flatnonzero((points == 39) & start)
        quote = quote[quote + 1 < n]
        for tail in _CONTRACTIONS:
            if not len(quote):
                break
            hit = quote[quote + len(tail) < n]
            for k, c in enumerate(tail, 1):
                hit = hit[(points[hit + k] == c) & ~first[hit + k]]
            start[hit + 1] = False
            after = hit + 1 + len(tail)
            start[after[after < n]] = True
            quote = np.setdiff1d(quote, hit, assume_unique=True)
        for a, b, _ in marks:
            start[a + 1 : b] = False
        heads = np.flatnonzero(start)
        tails = np.append(heads[1:], n)
        number = np.full(len(heads), -1, np.int64)
        for a, _, i in marks:
            number[np.searchsorted(heads, a)] = i
        inner = blank[heads] & (tails - heads > 1) & ~first[heads] & (heads > 0)
        inner &= ~white[np.maximum(heads - 1, 0)] & ~white[np.minimum(heads + 1, n - 1)]
        return at[heads], at[tails], number, inner

    def rank_merge(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and number of ids of each span: in all sequences at once, each one's lowest-rank pair is merged until none has a pair left."""
        lengths = ends - starts
        live = np.arange(len(starts))
        symbols = self.byte_id[ragged_take(raw, starts, lengths)]
        done_ids: list[np.ndarray] = []
        done_of: list[np.ndarray] = []
        none = len(self.merged)
        ranks = None
        while len(live):
            at = bounds(lengths)
            if ranks is None:
                ranks = np.full(len(symbols), none, np.int64)
                ranks[:-1] = self._ranks(symbols[:-1], symbols[1:])
                ranks[at[1:] - 1] = none
            low = np.minimum.reduceat(ranks, at[:-1])
            if (over := low == none).any():
                gone = np.repeat(over, lengths)
                done_ids.append(symbols[gone])
                done_of.append(np.repeat(live[over], lengths[over]))
                symbols, ranks, live, lengths, low = symbols[~gone], ranks[~gone], live[~over], lengths[~over], low[~over]
                if not len(live):
                    break
                at = bounds(lengths)
            low_at = np.repeat(low, lengths)
            hit = ranks == low_at
            spots = np.flatnonzero(hit)
            # of hits in a row (the same symbol again and again) every second one, from the left
            fresh = np.ones(len(spots), bool)
            fresh[1:] = spots[1:] != spots[:-1] + 1
            if not fresh.all():
                run = np.maximum.accumulate(np.where(fresh, np.arange(len(spots)), 0))
                spots = spots[(np.arange(len(spots)) - run) % 2 == 0]
            symbols[spots] = self.merged[low_at[spots]]
            keep = np.ones(len(symbols), bool)
            keep[spots + 1] = False
            changed = np.zeros(len(symbols), bool)
            changed[spots] = True
            changed[np.maximum(spots - 1, 0)] = True
            lengths = np.add.reduceat(keep.astype(np.int64), at[:-1])
            # the symbol before a merged one may itself have gone: then its own head is changed anyway
            symbols, ranks, changed = symbols[keep], ranks[keep], changed[keep]
            before = np.flatnonzero(changed)
            before = np.unique(np.concatenate([before, np.maximum(before - 1, 0)]))
            before = before[before < len(symbols) - 1]
            ranks[before] = self._ranks(symbols[before], symbols[before + 1])
            ranks[bounds(lengths)[1:] - 1] = none
        counts = np.zeros(len(starts), np.int64)
        if not done_ids:
            return np.zeros(0, np.int64), counts
        of, ids = np.concatenate(done_of), np.concatenate(done_ids)
        order = np.argsort(of, kind="stable")
        np.add.at(counts, of, 1)
        return ids[order], counts

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        i = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[i] == key, self.pair_rank[i], len(self.merged))

    def library_merge(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same by the tokenizers library. Pre-tokens of a space and something that isn't white space start there and end before the next such one whatever
        stands around, so they go to it as texts of JOINED each, which takes half the time; what a token stands for tells where each one's ids end."""
        lengths = ends - starts
        second = raw[np.minimum(starts + 1, len(raw) - 1)]
        led = (raw[starts] == 0x20) & (lengths > 1) & (second > 0x20) & ~np.isin(second, _MAYBE_WHITE)
        if not led.any() or any(b" " in w for w in self.special):
            return self._apart(raw, starts, ends)
        own, at = ragged_take(raw, starts[led], lengths[led]), bounds(lengths[led])
        led_ids, _ = self._encode(own, np.append(at[:-1:JOINED], at[-1]), CALL // JOINED)
        token_ends = np.cumsum(self.word_len[led_ids])
        spot = np.minimum(np.searchsorted(token_ends, at[1:]), len(token_ends) - 1)
        if token_ends[-1] != at[-1] or (token_ends[spot] != at[1:]).any():
            return self._apart(raw, starts, ends)
        counts = np.zeros(len(starts), np.int64)
        counts[led] = np.diff(spot + 1, prepend=0)
        rest, counts[~led] = self._apart(raw, starts[~led], ends[~led])
        ids = np.empty(len(led_ids) + len(rest), np.int64)
        mine = np.repeat(led, counts)
        ids[mine], ids[~mine] = led_ids, rest
        return ids, counts

    def _apart(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and number of ids of each span, each a text of its own."""
        lengths = ends - starts
        return self._encode(ragged_take(raw, starts, lengths), bounds(lengths), CALL)

    def _encode(self, raw: np.ndarray, at: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of all texts, and their number of each; step texts a call."""
        whole, cut = raw.tobytes(), at.tolist()
        counts, ids = np.zeros(len(cut) - 1, np.int64), [np.zeros(0, np.int64)]
        for i in range(0, len(counts), step):
            own = cut[i : i + step + 1]
            got = self.library.encode_batch_fast([whole[a:b].decode("utf-8") for a, b in zip(own[:-1], own[1:])], add_special_tokens=False)
            lists = [g.ids for g in got]
            counts[i : i + step] = [len(x) for x in lists]
            ids.append(np.fromiter(chain.from_iterable(lists), np.int64, int(counts[i : i + step].sum())))
        return np.concatenate(ids), counts


class Encoder:
    """Encodes texts, each distinct pre-token once for as long as it is remembered."""

    def __init__(self, vocab: Vocabulary, merge: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], kept: int = KEPT_PIECES) -> None:
        self.vocab, self.merge, self.kept = vocab, merge, kept
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # hashes of what is remembered, in order, and their places
        self.places = np.zeros(0, np.int32)
        self.ids, self.at, self.count = Growing(np.int32), Growing(np.int32), Growing(np.int32)
        self.bytes, self.bytes_at, self.size = Growing(np.uint8), Growing(np.int64), Growing(np.int32)

    def _store(self, ids: np.ndarray, counts: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> int:
        """Ids and bytes (of short ones) of pre-tokens; the place of the first."""
        lengths = ends - starts
        kept = np.where(lengths <= KEPT_BYTES, lengths, 0)
        self.bytes_at.add(self.bytes.n + bounds(kept)[:-1])
        self.bytes.add(ragged_take(raw, starts, kept))
        self.size.add(lengths)
        self.at.add(self.ids.n + bounds(counts)[:-1])
        self.ids.add(ids)
        return self.count.add(counts)

    def look_up(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, number: np.ndarray) -> np.ndarray:
        """The place of each pre-token in at and count. Hashes find what is remembered, bytes decide."""
        if self.count.n > self.kept or self.ids.n > 1 << 26:
            self.forget()
        lengths = ends - starts
        hashes = span_hashes(raw, starts, ends)
        hashes[number >= 0] ^= np.uint64(0xA5A5A5A5A5A5A5A5)
        keys, sample, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        alike = sample[inverse]
        if (lengths[alike] != lengths).any() or not same_bytes(raw, starts[alike], raw, starts, lengths).all():
            return self._without_hashes(raw, starts, ends, number)
        slot = np.searchsorted(self.keys, keys)
        old = np.zeros(len(keys), bool)
        if len(self.keys):
            old = self.keys[np.minimum(slot, len(self.keys) - 1)] == keys
        place = np.empty(len(keys), np.int64)
        known = self.places[slot[old]].astype(np.int64)
        s = sample[old]
        agrees = self.size.all[known] == lengths[s]
        agrees[agrees] = same_bytes(self.bytes.all, self.bytes_at.all[known[agrees]], raw, starts[s[agrees]], lengths[s[agrees]])
        taken = old.copy()  # hashes that are remembered for other bytes stay theirs
        old[old] = agrees
        place[old] = known[agrees]
        new = np.flatnonzero(~old)
        if len(new):
            place[new] = self._encoded(raw, starts[sample[new]], ends[sample[new]], number[sample[new]])
            short = new[(lengths[sample[new]] <= KEPT_BYTES) & ~taken[new]]
            self.keys = np.insert(self.keys, slot[short], keys[short])
            self.places = np.insert(self.places, slot[short], place[short])
        return place[inverse]

    def _encoded(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, number: np.ndarray) -> np.ndarray:
        place = np.empty(len(starts), np.int64)
        special = number >= 0
        for mine in (~special, special):
            if mine.any():
                a, b = starts[mine], ends[mine]
                ids, counts = (number[mine], np.ones(len(a), np.int64)) if mine is special else self.merge(raw, a, b)
                place[mine] = self._store(ids, counts, raw, a, b) + np.arange(len(a))
        return place

    def _without_hashes(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, number: np.ndarray) -> np.ndarray:
        """The same for texts in which two pre-tokens have the same hash; nothing is remembered."""
        whole = raw.tobytes()
        first: dict[tuple[bytes, int], int] = {}
        of = [first.setdefault((whole[a:b], i), len(first)) for a, b, i in zip(starts.tolist(), ends.tolist(), number.tolist())]
        sample = np.unique(np.array(of), return_index=True)[1]
        return self._encoded(raw, starts[sample], ends[sample], number[sample])[np.array(of)]

    def counts(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The number of tokens of each text."""
        parts = self.vocab.windows(raw, offsets)
        if len(parts) > 1:
            return sum(self.counts(*p) for p in parts)
        starts, ends, number, _ = self.vocab.split(raw, offsets)
        if not len(starts):
            return np.zeros(len(offsets) - 1, np.int64)
        place = self.look_up(raw, starts, ends, number)
        total = bounds(self.count.all[place])
        return np.diff(total[np.searchsorted(starts, offsets)])

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's ids start (one more than texts)."""
        ids, at, *_ = self.encode_cut(raw, offsets)
        return ids, at

    def encode_cut(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As encode; then the byte offsets of the safe cuts, and the number of ids before each."""
        starts, ends, number, inner = self.vocab.split(raw, offsets)
        if not len(starts):
            none = np.zeros(0, np.int64)
            return none, np.zeros(len(offsets), np.int64), none, none
        place = self.look_up(raw, starts, ends, number)
        total = bounds(self.count.all[place])
        ids = ragged_take(self.ids.all, self.at.all[place].astype(np.int64), self.count.all[place]).astype(np.int64)
        return ids, total[np.searchsorted(starts, offsets)], starts[inner], total[:-1][inner]


@cache
def encoder(path: str, merge: str, kept: int = KEPT_PIECES) -> Encoder:
    """The worker's encoder for a vocabulary file; it stays for the next task."""
    vocab = vocabulary(path)
    return Encoder(vocab, getattr(vocab, merge), kept)
