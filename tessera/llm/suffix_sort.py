"""Deep-shallow sorting of suffixes.

Three-way multikey quicksort orders the suffixes to a shallow depth: a group of suffixes that agree
so far is parted into those whose next character is less than, equal to or greater than a pivot's;
the equal ones go on with the character after it. Characters are big-endian words of eight bytes, and
one pass parts all open groups at once, each around a pivot of its own. Groups of a few suffixes are
put in order directly. Groups that still agree at the shallow depth have a long common prefix; blind
tries order them: a trie that keeps only the depths at which suffixes branch, descends without
comparing, and then compares once with the leaf it met.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

SHALLOW = 24
#: Groups of so many suffixes aren't parted any further but put in order by their next character.
FEW = 24


class _Leaf:
    __slots__ = ("text", "ids")

    def __init__(self, text: bytes, first: int):
        self.text, self.ids = text, [first]


class _Branch:
    __slots__ = ("depth", "kids")

    def __init__(self, depth: int, kids: dict):
        self.depth, self.kids = depth, kids


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n - (differ.bit_length() + 7) // 8


def _at(text: bytes, depth: int) -> int:
    return text[depth] if depth < len(text) else -1


class BlindTrie:
    """Orders texts by insertion; equal texts share a leaf."""

    def __init__(self):
        self.root: _Leaf | _Branch | None = None

    def insert(self, text: bytes, key: int) -> None:
        if self.root is None:
            self.root = _Leaf(text, key)
            return
        node = self.root
        while isinstance(node, _Branch):
            node = node.kids.get(_at(text, node.depth)) or next(iter(node.kids.values()))
        if node.text == text:
            node.ids.append(key)
            return
        depth, mine = _common(node.text, text), _at(text, _common(node.text, text))
        theirs = _at(node.text, depth)
        parent, node = None, self.root
        while isinstance(node, _Branch) and node.depth < depth:
            parent, node = node, node.kids[_at(text, node.depth)]
        leaf = _Leaf(text, key)
        if isinstance(node, _Branch) and node.depth == depth:
            node.kids[mine] = leaf
            return
        branch = _Branch(depth, {theirs: node, mine: leaf})
        if parent is None:
            self.root = branch
        else:
            parent.kids[_at(text, parent.depth)] = branch

    def leaves(self) -> list[list[int]]:
        """Keys of equal texts, in the order of the texts."""
        out, open_ = [], [self.root] if self.root else []
        while open_:
            node = open_.pop()
            if isinstance(node, _Leaf):
                out.append(node.ids)
            else:
                open_ += [node.kids[c] for c in sorted(node.kids, reverse=True)]
        return out


def _word(padded: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each position, as one big-endian number."""
    out = np.empty((len(at), 8), np.uint8)
    for k in range(8):
        out[:, k] = padded[at + k]
    return out.view(">u8").ravel().astype(np.uint64)


def _pivots(key: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The median of the first, middle and last key of each group."""
    x, y, z = key[first], key[first + size // 2], key[first + size - 1]
    return np.maximum(np.minimum(x, y), np.minimum(np.maximum(x, y), z))


def _parted(key: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, sizes by group of the less, equal and greater): each group parted around its pivot, stably."""
    pivot = np.repeat(_pivots(key, first, size), size)
    order, sizes = np.empty(len(key), np.int64), np.empty((len(first), 3), np.int64)
    less, more = key < pivot, key > pivot
    parts = (less, ~(less | more), more)
    for k, part in enumerate(parts):
        sizes[:, k] = np.add.reduceat(part, first, dtype=np.int64)
    begin = first[:, None] + np.cumsum(sizes, axis=1) - sizes
    for k, part in enumerate(parts):
        at = np.flatnonzero(part)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(sizes[:, k]) - sizes[:, k], sizes[:, k])
        order[np.repeat(begin[:, k], sizes[:, k]) + nth] = at
    return order, sizes


def _multikey(padded: np.ndarray, starts: np.ndarray, shallow: int, order: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Orders suffixes to the shallow depth, in place; returns the places whose groups still agree there."""

    def words(places: np.ndarray, depth: np.ndarray) -> np.ndarray:
        key = _word(padded, starts[order[places]] + depth)
        over = np.maximum(depth + 8 - shallow, 0)  # bytes beyond the shallow depth don't count
        return key >> (8 * over).astype(np.uint64)

    agreed, few = [], []
    first, size, depth = np.zeros(1, np.int64), np.array([len(order)]), np.zeros(1, np.int64)
    while len(first) or few:
        small = size <= FEW
        if small.any() and not small.all():  # set aside until no group is large
            few.append((first[small], size[small], depth[small]))
            first, size, depth = first[~small], size[~small], depth[~small]
        elif not len(first) or (few and small.all()):
            first, size, depth = (np.concatenate(x) for x in zip((first, size, depth), *few))
            few = []
        places = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
        key, begin = words(places, np.repeat(depth, size)), np.cumsum(size) - size
        if (size > FEW).any():
            by, sizes = _parted(key, begin, size)
            new_first = (first[:, None] + np.cumsum(sizes, axis=1) - sizes).ravel()
            new_depth = (depth[:, None] + np.array([0, 8, 0])).ravel()
            new_size = sizes.ravel()
        else:  # all are small: the order of their next characters, for each group at once
            by = np.lexsort((key, np.repeat(np.arange(len(size)), size)))
            new = np.zeros(len(key), bool)
            new[begin] = True
            new[1:] |= key[by][1:] != key[by][:-1]
            at = np.flatnonzero(new)
            new_first, new_size = places[at], np.diff(np.r_[at, len(key)])
            new_depth = np.repeat(depth, size)[at] + 8
        order[places] = order[places[by]]
        some = new_size > 0
        new_first, new_size, new_depth = new_first[some], new_size[some], new_depth[some]
        group[np.repeat(new_first - (np.cumsum(new_size) - new_size), new_size) + np.arange(new_size.sum())] = np.repeat(new_first, new_size)
        done = new_depth >= shallow
        f, n = new_first[done & (new_size > 1)], new_size[done & (new_size > 1)]
        agreed.append(np.repeat(f - (np.cumsum(n) - n), n) + np.arange(n.sum()))
        go_on = ~done & (new_size > 1)
        first, size, depth = new_first[go_on], new_size[go_on], new_depth[go_on]
    return np.sort(np.concatenate(agreed))


def sort_suffixes(data: np.ndarray, starts: np.ndarray, depth: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Orders the strings data[s : s + depth]; bytes beyond the end of data count as 0.

    Returns (order, group): positions in `starts` by string, and for each place of that order the
    number of its run of equal strings, which is the place where it begins. Equal strings stay in the
    order given.
    """
    n, shallow = len(starts), min(shallow, depth)
    order, group = np.arange(n), np.zeros(n, np.int64)
    if not n:
        return order, group
    open_ = _multikey(np.concatenate([data, np.zeros(depth + 8, np.uint8)]), starts, shallow, order, group)
    if depth > shallow and len(open_):
        _deepen(data, starts, depth, shallow, order, group, open_)
    return order, group


def _deepen(data: np.ndarray, starts: np.ndarray, depth: int, shallow: int, order: np.ndarray, group: np.ndarray, open_: np.ndarray) -> None:
    """Orders what agrees up to the shallow depth. Groups that agree to the full depth need no trie."""
    padded = np.concatenate([data, np.zeros(depth, np.uint8)])
    lead = starts[order[group[open_]]]
    odd = np.zeros(len(open_), bool)
    for d in range(shallow, depth):
        odd |= padded[starts[order[open_]] + d] != padded[lead + d]
    mixed = np.unique(group[open_][odd])
    ids = group[open_]
    first, last = np.searchsorted(ids, mixed, "left"), np.searchsorted(ids, mixed, "right")
    raw = padded.tobytes()
    for a, b in zip(open_[first], open_[last - 1] + 1):
        own, trie = order[a:b].copy(), BlindTrie()
        for k in own:
            at = int(starts[k]) + shallow
            trie.insert(raw[at : at + depth - shallow], int(k))
        place = a
        for keys in trie.leaves():
            order[place : place + len(keys)] = keys
            group[place : place + len(keys)] = place
            place += len(keys)


def suffix_array(text: bytes, positions: Sequence[int] | None = None) -> np.ndarray:
    """Start of every suffix of a text (or of those at `positions`), in the order of the suffixes."""
    data = np.frombuffer(text, np.uint8)
    starts = np.arange(len(data)) if positions is None else np.asarray(positions, np.int64)
    starts = starts[np.argsort(-starts, kind="stable")]  # of suffixes that padding makes equal, the shorter is first
    return starts[sort_suffixes(data, starts, max(1, len(data)))[0]]
