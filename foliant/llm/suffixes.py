"""Deep-shallow sorting of short byte strings: multikey quicksort first, then blind tries."""

from __future__ import annotations

import numpy as np

#: Bytes that multikey quicksort looks at before blind tries take over.
SHALLOW = 24


class BlindTrie:
    """A Patricia trie of strings of one length: inner nodes know where strings differ, not what they share."""

    def __init__(self, length: int):
        self.length, self.root = length, None

    def insert(self, text: bytes, item: int) -> None:
        """A leaf is (text, items); an inner node is [position, {byte: node}]."""
        if self.root is None:
            self.root = (text, [item])
            return
        node = self.root
        while isinstance(node, list):  # blindly: only the bytes at the branches are compared
            node = node[1].get(text[node[0]]) or next(iter(node[1].values()))
        other = node[0]
        if other == text:
            node[1].append(item)
            return
        differ = int.from_bytes(other, "big") ^ int.from_bytes(text, "big")
        at = self.length - (differ.bit_length() + 7) // 8
        parent, node = None, self.root
        while isinstance(node, list) and node[0] < at:
            parent, node = node, node[1][text[node[0]]]
        leaf = (text, [item])
        if isinstance(node, list) and node[0] == at:
            node[1][text[at]] = leaf
            return
        branch = [at, {text[at]: leaf, other[at]: node}]
        if parent is None:
            self.root = branch
        else:
            parent[1][text[parent[0]]] = branch

    def groups(self) -> list[list[int]]:
        """Items of equal strings, strings in ascending order."""
        out, stack = [], [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                stack.extend(node[1][b] for b in sorted(node[1], reverse=True))
            else:
                out.append(node[1])
        return out


def _eights(flat: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as one number that sorts as they do."""
    out = np.zeros(len(flat) - 7, np.uint64)
    for i in range(8):
        out = out << np.uint64(8) | flat[i : i + len(out)]
    return out


def multikey_quicksort(eights: np.ndarray, base: np.ndarray, group: np.ndarray, letters: int):
    """(order, groups): strings sorted within their groups by their first `letters` letters of eight bytes, and the
    (begin, end) in that order of all groups of two or more that these letters don't tell apart.

    group: ascending. Every round splits each open group in three around the median of its first, middle and last
    string's letter: less, equal, greater; those equal go on to the next letter. All open groups split in one pass.
    """
    order, place, depth, tied = np.arange(len(base)), np.arange(len(base)), np.zeros(len(base), np.int64), []
    letter = eights[base] if letters else np.zeros(len(base), np.uint64)
    while True:
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(group)))
        ended = depth[first] >= letters
        tied += [(int(a), int(a) + int(n)) for a, n in zip(place[first[ended & (size > 1)]], size[ended & (size > 1)])]
        open_ = np.repeat(~ended & (size > 1), size)
        place, group, depth, letter = (x[open_] for x in (place, group, depth, letter))
        if not len(place):
            return order, sorted(tied)
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        size = np.diff(np.append(first, len(group)))
        three = np.stack([letter[first], letter[first + size // 2], letter[first + size - 1]])
        pivot = np.repeat(np.sort(three, axis=0)[1], size)
        side = 1 + (letter > pivot) - (letter < pivot).astype(np.int64)
        key = np.repeat(np.arange(len(first)), size) * 3 + side
        by = np.argsort(key, kind="stable")
        order[place] = order[place[by]]
        group, depth, letter = key[by], depth[by], letter[by]
        on = np.flatnonzero(group % 3 == 1)
        depth[on] += 1
        on = on[depth[on] < letters]
        letter[on] = eights[base[order[place[on]]] + 8 * depth[on]]


def equal_runs(texts: list[bytes], starts: np.ndarray, owners: np.ndarray, buckets: np.ndarray, length: int) -> list[list[int]]:
    """Sort the strings texts[owners[i]][starts[i] : starts[i] + length] within their buckets; runs of equal ones.

    Strings of one bucket are ordered by multikey quicksort over letters of eight bytes up to SHALLOW bytes; whatever
    still shares them then goes into a blind trie. Only runs of two or more are returned, as positions i, bucket by
    bucket in ascending order.
    """
    if len(starts) < 2:
        return []
    flat = np.frombuffer(b"".join(texts) + bytes(8), np.uint8)
    base = np.append(0, np.cumsum([len(t) for t in texts]))[owners] + starts
    by = np.argsort(buckets, kind="stable")
    order, groups = multikey_quicksort(_eights(flat), base[by], buckets[by], min(SHALLOW, length) // 8)
    out, order_list, owner_list, start_list = [], by[order].tolist(), owners.tolist(), starts.tolist()
    for a, b in groups:
        trie = BlindTrie(length)
        for i in order_list[a:b]:
            s = start_list[i]
            trie.insert(texts[owner_list[i]][s : s + length], i)
        out += [run for run in trie.groups() if len(run) > 1]
    return out
