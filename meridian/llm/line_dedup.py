"""Line dedup: SimHashes of normalised lines, a join on pigeonhole blocks, edit similarity to decide; one line of each connected group stays.

The SimHash of a line has BLOCKS blocks of 64 bits. Not all features of the line vote in a block, but the three that come first in
the block's own orders of all features. So an edit does not flip bits everywhere, but leaves a block as it is unless it takes away
or displaces one of its voters, and similar lines agree on some blocks. A feature is a word, with the next where it is short, as
frequent words are. Lines meet where a block agrees; very short ones (TINY) where the votes of all words but any one do. All pairs
that meet are decided by edit similarity, except those whose two SimHashes of all words differ in over FAR or FAR_LONG of 128 bits:
unrelated lines differ in 64 on average, lines with one word in ten replaced in 18.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.components import components, linked_in_shards
from meridian.llm.shared import fresh, in_set, pack, put_set, skew_join, slices, small_batches, text_bytes, unpack, written
from meridian.llm.words import U, bucket_of, docs_words, lane_votes, majority, mix, pair

SIMILAR, MIN_WORDS = 0.8, 5
FAR, FAR_LONG, LENGTHY = 40, 28, 100  #: most bits that may differ, the same for lines of LENGTHY characters or more
TINY = (3, 10)  #: words of the lines that meet under all votes but one word's
LONGER = 9  #: fewest words of the lines that meet under blocks
BLOCKS = 10
ALONE = 6  #: bytes of the shortest word that is a feature by itself
FEW = 5  #: lines with at most so many different features, as far as the orders show, meet under each of them too
#: ASCII letters lower-cased, digits as 0, white space as a space; ASCII punctuation goes.
_TABLE = bytes(ord("0") if 48 <= i < 58 else i + 32 if 65 <= i < 91 else 32 if 9 <= i < 14 else i for i in range(256))
_GONE = bytes(i for i in range(33, 127) if not chr(i).isalnum())


_BY_LINE = bytes(10 if i == 10 else x for i, x in enumerate(_TABLE))


def normal(line: bytes, table: bytes = _TABLE) -> bytes:
    out = line.translate(table, _GONE)
    while b"  " in out:
        out = out.replace(b"  ", b" ")
    return out.strip(b" ")


def normal_lines(text: bytes) -> list[bytes]:
    """normal() of each line of a text."""
    return [x.strip(b" ") for x in normal(text, _BY_LINE).split(b"\n")]


def levenshtein(a: str, b: str, most: int | None = None) -> int:
    """Edits between strings, a column of the table as bits of one number at a time; once over `most` is sure, any number over it."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    at: dict[str, int] = {}
    for i, c in enumerate(b):
        at[c] = at.get(c, 0) | 1 << i
    ones, top = (1 << len(b)) - 1, 1 << len(b) - 1
    up, down, far = ones, 0, len(b)
    end = len(a) + (len(a) + len(b) if most is None else most)
    for i, c in enumerate(a, 1):
        eq = at.get(c, 0)
        x = eq | down
        d0 = (((x & up) + up) ^ up) | x
        right, left = down | (ones & ~(d0 | up)), up & d0
        if right & top:
            far += 1
        elif left & top:
            far -= 1
        if far + i > end:  # each column to come takes off one at most
            return far + i - len(a)
        right = (right << 1 | 1) & ones
        up, down = (left << 1 & ones) | (ones & ~(d0 | right)), right & d0
    return far


def _common(a: str, i: int, b: str, j: int) -> int:
    """How far a from i on equals b from j on."""
    low, high = 0, min(len(a) - i, len(b) - j) + 1
    while high - low > 1:
        mid = (low + high) // 2
        if a[i + low : i + mid] == b[j + low : j + mid]:
            low = mid
        else:
            high = mid
    return low


def _script_cost(a: str, b: str, most: int, anchor: int = 10, reach: int = 24) -> int:
    """The cost of one edit script, so no less than the distance: at a difference, go on where the next `anchor` characters agree again."""
    i = j = cost = 0
    while i < len(a) and j < len(b) and cost <= most:
        n = _common(a, i, b, j)
        i, j = i + n, j + n
        for skip in range(reach):
            piece = a[i + skip : i + skip + anchor]
            if len(piece) == anchor and (at := b.find(piece, j, j + reach + anchor)) >= 0:
                cost, i, j = cost + max(skip, at - j), i + skip, at
                break
        else:
            break
    return cost + max(len(a) - i, len(b) - j)


def _unlike(a: str, b: str, least: float) -> tuple[str, str, int]:
    """What is left of both, the longer first, without the beginning and end that they share, and the edits that are allowed."""
    allowed = int((1 - least) * max(len(a), len(b)) + 1e-9)
    i = _common(a, 0, b, 0)
    a, b = a[i:], b[i:]
    j = _common(a[::-1], 0, b[::-1], 0)
    a, b = a[: len(a) - j], b[: len(b) - j]
    return (a, b, allowed) if len(a) >= len(b) else (b, a, allowed)


def edit_similar(a: str, b: str, least: float = SIMILAR) -> bool:
    """1 - edits / longer length is at least `least`."""
    return bool(all_edit_similar([a], [b], least)[0])


def all_edit_similar(a: list[str], b: list[str], least: float = SIMILAR) -> np.ndarray:
    """edit_similar of each pair: most are decided by what they share, the rest by their distances, many at once where that costs less."""
    out, rest = np.zeros(len(a), bool), []
    for k, (x, y) in enumerate(zip(a, b)):
        x, y, allowed = _unlike(x, y, least)
        if len(x) - len(y) > allowed:
            continue
        if len(x) <= allowed or _script_cost(x, y, allowed) <= allowed:
            out[k] = True
        elif len(set(x + y)) > 255:  # more than a byte tells apart
            out[k] = levenshtein(x, y, allowed) <= allowed
        else:
            rest.append((k, x, y, allowed))
    rest.sort(key=lambda r: -len(r[1]))
    at = 0
    while at < len(rest):
        k, x, y, allowed = rest[at]
        part = rest[at : at + max(1, SIDE_BY_SIDE // (len(x) + 256))]
        words = max(r[3] for r in part) // 64 + 1
        if len(x) * (COLUMN + COLUMN_WORD * words) < sum(len(r[1]) for r in part):
            coded = [_coded(*r[1:3]) for r in part]
            out[[r[0] for r in part]] = _within([c[0] for c in coded], [c[1] for c in coded], np.array([r[3] for r in part]))
            at += len(part)
        else:
            out[k] = levenshtein(x, y, allowed) <= allowed
            at += 1
    return out


SIDE_BY_SIDE = 1 << 20  #: bytes of texts whose distances are computed at once
COLUMN, COLUMN_WORD = 30, 4  #: what a column costs there, and more for each word of the band; 1: a column of one pair by itself


def _coded(a: str, b: str) -> tuple[bytes, bytes]:
    """Both with a byte under 255 for each character; at most 255 different ones."""
    if a.isascii() and b.isascii():
        return a.encode(), b.encode()
    _, code = np.unique(np.frombuffer((a + b).encode("utf-32-le"), np.uint32), return_inverse=True)
    code = code.astype(np.uint8).tobytes()
    return code[: len(a)], code[len(a) :]


def _within(a: list[bytes], b: list[bytes], most: np.ndarray) -> np.ndarray:
    """Which pairs have at most `most` edits; a no shorter than b, in falling order of length.

    As levenshtein, for all pairs at once and only in the band of diagonals that a script of `most` edits can reach. Bit k
    of column i is row i + low + k of the table; the distance is followed along the last diagonal.
    """
    n, m = (np.array([len(x) for x in t], np.int64) for t in (a, b))
    side = (most - (n - m)) // 2
    low = m - n - side
    words = int((n - m + 2 * side).max()) // 64 + 1
    front = (int(-low.min()) // 64 + 1) * 64
    width = front + (max(int(m.max()), int((n + low).max())) // 64 + words + 2) * 64
    chars = np.zeros((len(b), width), np.uint8)
    for k, x in enumerate(b):
        chars[k, front : front + len(x)] = np.frombuffer(x, np.uint8) + 1
    text = np.zeros((int(n.max()), len(a)), np.uint8)
    for k, x in enumerate(a):
        text[: len(x), k] = np.frombuffer(x, np.uint8) + 1
    used = np.flatnonzero(np.bincount(chars.reshape(-1), minlength=256)[1:]) + 1
    number = np.zeros(256, np.int64)  # 0: a character that no b has
    number[used] = np.arange(1, len(used) + 1)
    places = np.zeros((len(used) + 1, len(b), width // 64), U)
    for k, c in enumerate(used):
        places[k + 1] = np.packbits(chars == c, axis=1, bitorder="little").view(U)
    places, stride, cells = places.reshape(-1), len(b) * (width // 64), np.arange(words + 1)[:, None]
    row = np.arange(len(b)) * (width // 64)
    # before the first column all rows of b go up by one, those above them nowhere
    up = np.ascontiguousarray(np.packbits(np.arange(words * 64) >= -low[:, None], axis=1, bitorder="little").view(U).T)
    down, far, who, ok = np.zeros_like(up), n - m, np.arange(len(a)), np.zeros(len(a), bool)
    offset, last, shift_last, begins = front + low, side // 64, (side % 64).astype(U), n - m
    one, top = U(1), U(63)
    for i in range(len(text)):
        if i % 32 == 0:
            ended, hopeless = i >= n, far > most
            if (ended | hopeless).any():
                ok[who[ended & ~hopeless]] = True
                go = ~(ended | hopeless)
                if not go.any():
                    return ok
                who, n, most, far, row, offset, last, shift_last, begins = (x[go] for x in (who, n, most, far, row, offset, last, shift_last, begins))
                up, down = np.ascontiguousarray(up[:, go]), np.ascontiguousarray(down[:, go])
        at = np.minimum(offset + i, width - 64 * (words + 1))
        found = places.take(number[text[i, who]] * stride + row + (at >> 6) + cells)
        by = (at & 63).astype(U)
        eq = found[:-1] >> by | found[1:] << one << (top - by)
        x = eq & up
        total = x + up
        over = total < up
        for w in range(1, words):
            total[w] += over[w - 1]
            over[w] |= over[w - 1] & (total[w] == 0)
        d0 = (total ^ up) | eq | down
        right, left = down | ~(d0 | up), d0 & up
        same = d0[last, np.arange(len(who))] >> shift_last & one
        far = far + ((i >= begins) & (i < n) & (same == 0))
        moved = d0 >> one
        moved[:-1] |= d0[1:] << top
        up, down = left | ~(moved | right), moved & right
    ok[who[far <= most]] = True
    return ok


_KIND = mix(np.arange(1, 33, dtype=U) * U(0x9E3779B97F4A7C15))  #: tells keys of different blocks apart
#: Orders of the features: each block's voters are the first in three orders.
_ORDERS = [(x, y, U(pow(int(y), -1, 1 << 64))) for x, y in (mix(np.array([2 * i + 101, 2 * i + 102], U) * U(0x9E3779B97F4A7C15)) | U(1) for i in range(4 * BLOCKS))]


def _key(fp: np.ndarray, votes: np.ndarray) -> np.ndarray:
    return mix(fp ^ _KIND[0]) + mix(votes.astype(U) ^ _KIND[0])


def _three(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The SimHash of three votes."""
    return a & b | a & c | b & c


def word_keys(h: np.ndarray, size: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lines with word hashes h, words of `size` bytes, n words each: two SimHashes of all words; keys under which lines meet, and the number of the line of each."""
    of, keys, owner = np.repeat(np.arange(len(n)), n), [np.zeros(0, U)], [np.zeros(0, np.int64)]
    all_ones, _ = lane_votes(h, of, len(n))
    whole = majority(all_ones, n)
    second = majority(lane_votes(mix(h ^ _KIND[-1]), of, len(n))[0], n)
    tiny = np.flatnonzero((n >= TINY[0]) & (n <= TINY[1]))
    if len(tiny):
        keys.append(_key(whole[tiny], n[tiny]))
        owner.append(tiny)
        word = np.flatnonzero((n[of] >= TINY[0]) & (n[of] <= TINY[1]))
        line = of[word]
        without = all_ones[line] - np.unpackbits(h[word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        keys.append(_key(majority(without, n[line] - 1), n[line] - 1))
        owner.append(line)
    # short words are the frequent ones: each votes together with the next
    vote = h.copy()
    if len(h) > 1:
        joined = np.flatnonzero((size[:-1] < ALONE) & (of[1:] == of[:-1]))
        vote[joined] = pair(h[joined], h[joined + 1])
    some = np.flatnonzero(n >= LONGER)
    if len(some):
        v = vote[n[of] >= LONGER]
        start, drawn = np.cumsum(n[some]) - n[some], []
        for i in range(BLOCKS):
            voter = [mix((np.minimum.reduceat((v ^ x) * y, start) * back) ^ x) for x, y, back in _ORDERS[4 * i : 4 * i + 4]]
            *voter, other = voter  # a fourth stands in where two are the same
            voter[1] = np.where(voter[1] == voter[0], other, voter[1])
            voter[2] = np.where((voter[2] == voter[0]) | (voter[2] == voter[1]), other, voter[2])
            ok = (voter[0] != voter[1]) & (voter[0] != voter[2]) & (voter[1] != voter[2])  # one or two features say little
            keys.append(mix(_three(*voter) ^ _KIND[i + 1])[ok])
            owner.append(some[ok])
            drawn += [*voter, other]
        # lines of few different features: any one of them, with the number of words to within a fifth
        kinds = np.sort(np.stack(drawn, axis=1), axis=1)
        few = np.flatnonzero((kinds[:, 1:] != kinds[:, :-1]).sum(axis=1) < FEW)
        if len(few):
            span = np.floor(np.log(n[some[few]]) / np.log(1.25)).astype(U)
            kinds = kinds[few]
            new = np.concatenate((np.ones((len(few), 1), bool), kinds[:, 1:] != kinds[:, :-1]), axis=1)
            line, at = np.nonzero(new)
            for more in (U(0), U(1)):
                keys.append(mix(kinds[line, at] ^ _KIND[BLOCKS + 1]) + mix((span[line] + more) ^ _KIND[BLOCKS + 2]))
                owner.append(some[few[line]])
    return whole, second, np.concatenate(keys), np.concatenate(owner)


def line_keys(lines: list[bytes], min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys under which normalised lines of at least min_words words meet, and the number of the line of each."""
    keys, owner = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    for first, h, size, n in docs_words(lines):
        mine = np.repeat(n >= min_words, n)
        _, _, key, line = word_keys(h[mine], size[mine], np.where(n >= min_words, n, 0))
        keys.append(key)
        owner.append(line + first)
    return np.concatenate(keys), np.concatenate(owner)


def _lines(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """Of all lines of the texts: number of the text, number of the line, normal form, hash of that."""
    import xxhash

    parts = [normal_lines(x) for x in texts]
    n = np.array([len(x) for x in parts], np.int64)
    forms = [x for p in parts for x in p]
    h = np.fromiter(map(xxhash.xxh64_intdigest, forms), np.uint64, len(forms))
    return np.repeat(np.arange(len(texts)), n), np.arange(len(forms)) - np.repeat(np.cumsum(n) - n, n), forms, h


FLUSH = 1 << 18  #: keys that a task holds before it sends them on


def _measure(min_words: int, buckets: int):
    """Rows of two kinds: a line (k, rk, line, h, size, fp, fp2), or the packed keys and hashes of many lines, by bucket of the key (bucket, packed)."""

    def run(batches):
        kind, held, many = None, [], 0

        def flush():
            key, sig = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((sig, key))
            key, sig = key[order], sig[order]
            first = np.concatenate(([True], (key[1:] != key[:-1]) | (sig[1:] != sig[:-1])))
            key, sig = key[first], sig[first]
            b = bucket_of(key, buckets)
            cut = np.flatnonzero(np.diff(b, prepend=-1))
            blobs = [pack(key[i:j], sig[i:j]) for i, j in zip(cut, [*cut[1:], len(key)])]
            return pa.RecordBatch.from_arrays([pa.nulls(len(cut), kind), *(pa.nulls(len(cut), t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64())), pa.array(b[cut].astype(np.int32)), pa.array(blobs, pa.binary())], names=NAMES)

        for batch in slices(batches):
            kind = batch.column(1).type
            text, number, forms, h = _lines([x or b"" for x in batch.column(2).cast("binary").to_pylist()])
            distinct, at, back = np.unique(h, return_index=True, return_inverse=True)
            forms = [forms[i] for i in at]
            size, fp = np.array([len(x) if x.isascii() else len(x.translate(None, _INNER)) for x in forms], np.int32), np.zeros(len(forms), U)
            fp2 = fp.copy()
            ok = np.zeros(len(forms), bool)
            for first, words, length, n in docs_words(forms):
                part = slice(first, first + len(n))
                ok[part] = n >= max(min_words, 1)
                mine, n_ok = np.repeat(ok[part], n), np.where(ok[part], n, 0)
                fp[part], fp2[part], key, line = word_keys(words[mine], length[mine], n_ok)
                held.append((key, distinct[line + first]))
                many += len(key)
            keep = ok[back]
            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(text[keep])), batch.column(0).take(pa.array(text[keep])), pa.array(number[keep].astype(np.int32)), pa.array(h[keep].view(np.int64)), pa.array(size[back][keep]), pa.array(fp[back][keep].view(np.int64)), pa.array(fp2[back][keep].view(np.int64)), pa.nulls(int(keep.sum()), pa.int32()), pa.nulls(int(keep.sum()), pa.binary())], names=NAMES)
            if many >= FLUSH:
                yield flush()
                held, many = [], 0
        if many:
            yield flush()

    return run


NAMES = ["k", "rk", "line", "h", "size", "fp", "fp2", "bucket", "packed"]
_INNER = bytes(range(128, 192))  #: bytes within a character


def _meetings(key, group):
    """Of a bucket: for each key that two or more lines have, (s, chunk, n, least, sigs): a hash of the set of these lines, their number,
    the least of them, and their sorted hashes in chunks. A set comes once, whatever the number of its keys."""
    parts = [unpack(x) for x in group["packed"].to_pylist()]
    s, sig = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((sig, s))
    s, sig = s[order], sig[order]
    first = np.concatenate(([True], (s[1:] != s[:-1]) | (sig[1:] != sig[:-1])))
    s, sig = s[first], sig[first]
    start = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, np.int64)
    n = np.diff(np.append(start, len(s)))
    least = np.minimum.reduceat(sig.view(np.int64), start) if len(s) else np.zeros(0, np.int64)
    start, n, least = start[n > 1], n[n > 1], least[n > 1]
    if not len(n):
        return pa.table({"s": pa.array([], pa.int64()), "chunk": pa.array([], pa.int32()), "n": pa.array([], pa.int64()), "least": pa.array([], pa.int64()), "sigs": pa.array([], pa.binary())})
    upto = np.concatenate((np.zeros(1, U), np.cumsum(mix(sig), dtype=U)))
    name, at = np.unique(mix(upto[start + n] - upto[start] + n.astype(U)), return_index=True)
    start, n, least, sig = start[at], n[at], least[at], sig.view(np.int64)
    chunks = -(-n // CHUNK)
    which = np.repeat(np.arange(len(n)), chunks)
    chunk = np.arange(len(which)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    begin = start[which] + chunk * CHUNK
    end = np.minimum(begin + CHUNK, (start + n)[which])
    return pa.table({"s": name.view(np.int64)[which], "chunk": pa.array(chunk, pa.int32()), "n": n[which], "least": least[which], "sigs": pa.array([sig[i:j].tobytes() for i, j in zip(begin, end)], pa.binary())})


CHUNK = 1024  #: hashes of lines that go in one value


def _sets(batches):
    """Streams rows of _meetings, all of one s and chunk in one task; yields (s, n, least, sig), each set once."""
    seen = set()
    for batch in batches:
        new = []
        for i, x in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            if x not in seen:
                seen.add(x)
                new.append(i)
        s, n, least = (batch.column(i).to_numpy()[new] for i in (0, 2, 3))
        sigs = [np.frombuffer(x, np.int64) for x in batch.column(4).take(pa.array(new, pa.int64())).to_pylist()]
        many = [len(x) for x in sigs]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(x, many)) for x in (s, n, least)] + [pa.array(np.concatenate([np.zeros(0, np.int64), *sigs]))], names=["s", "n", "least", "sig"])


def _texts(wanted):
    def run(batches):
        for batch in slices(batches):
            _, _, forms, h = _lines([x or b"" for x in batch.column(0).cast("binary").to_pylist()])
            h, first = np.unique(h, return_index=True)
            ok = in_set(wanted, h)
            yield pa.RecordBatch.from_arrays([pa.array(h[ok].view(np.int64)), pa.array([forms[i].decode("utf-8", "replace") for i in first[ok]], pa.string())], names=["id", "text"])

    return run


AT_ONCE = 4096  #: pairs that are decided together


def _edit_similar(batches):
    """Streams pairs with both texts; yields those that are edit_similar."""

    def decided():
        a, b, ta, tb = (pa.chunked_array([x.column(i) for x in held]) for i in range(4))
        ok = pa.array(all_edit_similar(ta.to_pylist(), tb.to_pylist()), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(x.filter(ok).to_numpy(), pa.int64()) for x in (a, b)], names=["a", "b"])

    held, rows, size = [], 0, 0
    for batch in slices(batches):
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= AT_ONCE or size >= 1 << 23:
            yield decided()
            held, rows, size = [], 0, 0
    if held:
        yield decided()


CELLS = 1 << 16  #: pairs whose SimHashes are compared at once


def _beside(batches):
    """Streams (s, part, query, sig, size, fp, fp2, d, inner, ss, text), sorted with the rows of a part before its queries (see linked_in_shards); yields links.

    Pairs within the radius are decided by edit similarity, unless links of this task connect their components d already.
    """
    up, held, links = {}, [], []

    def root(x):
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def decide():
        ok = all_edit_similar([x[2][k] for x, _, k, _ in held], [y[2][k] for _, y, _, k in held])
        for (x, y, i, j), similar in zip(held, ok):
            if similar:
                links.append(sorted((x[0][i].item(), y[0][j].item())))
                up[root(x[4][i])] = root(y[4][j])
        held.clear()

    def roots(ds):
        return np.fromiter(map(root, ds), np.int64, len(ds))

    def found(s, x, y):
        """Hold or decide the pairs of queries x and rows y."""
        step = max(1, CELLS // len(y[0]))
        for at in range(0, len(x[0]), step):
            part = slice(at, at + step)
            size, other = x[1][part, None], y[1]
            bits = np.bitwise_count(x[5][part, None] ^ y[5]) + np.bitwise_count(x[6][part, None] ^ y[6])
            near = (np.minimum(size, other) >= SIMILAR * np.maximum(size, other) - 1e-9) & (bits <= np.where(size < LENGTHY, FAR, FAR_LONG))
            near &= (roots(x[4][part])[:, None] != roots(y[4])) & (y[7] | (x[0][part, None] < y[0]))
            for i, j in zip(*(k.tolist() for k in np.nonzero(near))):
                if s == min(x[3][at + i] & y[3][j]):
                    held.append((x, y, at + i, j))
            if len(held) >= AT_ONCE:
                decide()

    now, rows = None, []
    for batch in slices(batches, 1000):
        s, part, query, sig, size, fp, fp2 = (batch.column(i).to_numpy() for i in range(7))
        fp, fp2 = fp.view(U), fp2.view(U)  # bits of a signed number are counted in its absolute value
        cut = np.flatnonzero(np.concatenate(([True], (s[1:] != s[:-1]) | (part[1:] != part[:-1]) | (query[1:] != query[:-1]))))
        for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(s)]):
            if now != (s[i], part[i]):
                now, rows = (s[i], part[i]), []
            at = batch.slice(i, j - i)
            one = (sig[i:j], size[i:j], at.column(10).to_pylist(), [frozenset(x) for x in at.column(9).to_pylist()], at.column(7).to_pylist(), fp[i:j], fp2[i:j], at.column(8).to_numpy(zero_copy_only=False))
            if not query[i]:
                rows.append(one)
            else:
                for y in rows:
                    found(s[i].item(), one, y)
        if len(links) > 50_000:
            yield _linked(links)
            links.clear()
    decide()
    yield _linked(links)


def _linked(links):
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])


BUCKET = 1 << 23  #: bytes of text whose lines' keys make one bucket


def _line_links(texts: DataFrame, forms_of: DataFrame, packed: DataFrame, buckets: int, limit: int = 1024) -> DataFrame:
    """Links (a, b) between hashes of lines, enough to connect those that meet and are edit_similar."""
    sets = packed.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_meetings, "s long, chunk int, n long, least long, sigs binary")
    met = written(sets.repartition("s", "chunk").mapInArrow(_sets, "s long, n long, least long, sig long"))
    some = met.select("sig").distinct()
    known = written(forms_of.select(F.col("h").alias("sig"), "size", F.struct("fp", "fp2").alias("fp")).join(some, "sig", "left_semi"))
    wanted = put_set(known, "sig", max(1, -(-known.count() // 2_000_000)))
    forms = written(texts.mapInArrow(_texts(wanted), "id long, text string").dropDuplicates(["id"]))

    def decided(pairs):
        one, other = (forms.select(F.col("id").alias(x), F.col("text").alias(f"t{x}")) for x in "ab")
        # one text a pair, so the pairs alone tell how often each text is wanted
        many = written(pairs.groupBy("a").agg(F.count("*").alias("n")))
        return skew_join(pairs.join(other, "b"), one, "a", many).select("a", "b", "ta", "tb").mapInArrow(_edit_similar, "a long, b long")

    def beside(rows):
        rows = rows.join(forms.withColumnRenamed("id", "sig"), "sig").select("s", "part", "query", "sig", "size", "fp.fp", "fp.fp2", "d", "inner", "ss", "text")
        return rows.repartition("s", "part").sortWithinPartitions("s", "part", "query").mapInArrow(_beside, "a long, b long")

    return linked_in_shards(met, decided, SIMILAR, f"CASE WHEN nx < {LENGTHY} THEN {FAR} ELSE {FAR_LONG} END", limit, bits="bit_count(fx.fp ^ fy.fp) + bit_count(fx.fp2 ^ fy.fp2)", known=known, beside=beside)


def repeated_lines(docs: DataFrame, key: str, text: str, min_words: int = MIN_WORDS) -> DataFrame:
    """(rk, lines): by xxhash64(key, text), the numbers of the lines that go; of each group the first by key, then rk, stays."""
    small_batches(docs.sparkSession)
    buckets = max(1, text_bytes(docs, text) // BUCKET)
    d = docs.select(F.xxhash64(key, text).alias("rk"), F.col(key).alias("k"), F.col(text).alias("t"))
    kind = d.schema["k"].dataType.simpleString()
    found = written(d.mapInArrow(_measure(min_words, buckets), f"k {kind}, rk long, line int, h long, size int, fp long, fp2 long, bucket int, packed binary"))
    lines, packed = found.where("packed IS NULL").drop("bucket", "packed"), found.where("packed IS NOT NULL").select("bucket", "packed")
    per = written(lines.groupBy("h").agg(F.count("*").alias("n"), F.min("size").alias("size"), F.min("fp").alias("fp"), F.min("fp2").alias("fp2")))
    groups = components(_line_links(d.select("t"), per, packed, buckets))
    of = per.join(groups.select(F.col("id").alias("h"), "component"), "h", "left")
    of = written(of.where("n > 1 OR component IS NOT NULL").select("h", "n", F.coalesce("component", "h").alias("group")))
    members = written(skew_join(lines.select("rk", "line", "h", "k"), of.select("h", "group"), "h", of.select("h", "n")))
    place = F.struct("k", "rk", "line")
    first = members.groupBy("group").agg(F.min(place).alias("first"))
    gone = skew_join(members, first, "group", of.groupBy("group").agg(F.sum("n").alias("n")))
    return gone.where(~place.eqNullSafe(F.col("first"))).groupBy("rk").agg(F.collect_set("line").alias("lines"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with its repeated lines removed, and n_removed (which takes the place of a column of that name).

    Lines end at \\n. Lines with fewer than min_words words after normalising always stay (those without words whatever it is), and
    so does the first of each group: by key (null first), then place. Lines of under TINY[0] words meet only as equal normal
    forms. Rows equal in key and text are one document: all keep the same lines. Null texts stay null; a document may
    become empty but stays, and a table without rows gives one without rows.
    """
    name, hashed, lines = fresh(docs, "_key", "_rk", "_lines")
    gone = repeated_lines(docs, key, text, min_words).withColumnsRenamed({"rk": hashed, "lines": lines})
    joined = docs.withColumn(name, F.xxhash64(key, text)).join(gone.hint("shuffle_hash"), F.col(name) == F.col(hashed), "left")
    parts = F.split(text, "\n")
    # runs of lines between those that go, so that each line is looked at once
    whole = F.struct(parts.alias("p"), F.array_append(F.array_sort(lines), F.size(parts)).alias("g"))
    last = lambda s, i: F.when(i == 0, -1).otherwise(F.get(s["g"], i - 1))
    runs = lambda s: F.flatten(F.transform(s["g"], lambda x, i: F.slice(s["p"], last(s, i) + 2, x - last(s, i) - 1)))
    left = F.get(F.transform(F.array(whole), lambda s: F.array_join(runs(s), "\n")), F.lit(0))
    kept = [c for c in docs.columns if c.lower() != "n_removed"]
    return joined.withColumns({text: F.when(F.col(lines).isNull(), F.col(text)).otherwise(left), "n_removed": F.coalesce(F.size(lines), F.lit(0))}).select(*kept, "n_removed")


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Per document: lines removed, and a digest of the text that is left. Lines of any length take part."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    left = dedup_lines(docs, min_words=1)
    return left.select("doc_id", F.col("n_removed").cast("long").alias("n_removed"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
