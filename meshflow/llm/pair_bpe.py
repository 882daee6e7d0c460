"""Byte-pair encoding as a dynamic program over prefixes.

The encoding of every prefix of a string ends in exactly one token. If that token is t, what stands
before it is the encoding of the shorter prefix, whose last token u must agree with t: encoding u + t
alone must give [u, t]. So the last token of each prefix, and with it the number of tokens, follows
from earlier prefixes by looking at the few tokens that start or end there. No merge is replayed over
the whole string; merging is only used on two tokens at a time to learn whether they agree, and the
answers are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

#: Entries that a memo may hold before it is emptied: it bounds a worker's memory, not what is computed.
MEMO = 600_000

_NONE = float("inf")


def merge(symbols: list, rank: Callable[[object, object], float]) -> list:
    """Plain byte-pair merging of a short list: the best rank first, leftmost among equals (inf: no merge)."""
    symbols = list(symbols)
    ranks = [rank(a, b) for a, b in zip(symbols, symbols[1:], strict=False)]
    while ranks and (best := min(ranks)) != _NONE:
        i = ranks.index(best)
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        del ranks[i]
        if i < len(ranks):
            ranks[i] = rank(symbols[i], symbols[i + 1])
        if i:
            ranks[i - 1] = rank(symbols[i - 1], symbols[i])
    return symbols


class PrefixEncoder:
    """Last token and token count of every prefix of a sequence of symbols (bytes or characters)."""

    def __init__(self, pieces: Sequence, rank: Callable[[object, object], float], split: Callable[[object], list]):
        self.pieces: list = []
        self.number: dict = {}
        self.root: dict = {}  # a trie: symbol -> (number of the piece that ends here or -1, what follows)
        for p in pieces:
            self.add(p)
        self.rank, self.split = rank, split
        self.longest = max(map(len, self.pieces), default=1)
        self.agreed: dict[int, bool] = {}

    def add(self, piece) -> int:
        """Number of a new piece; a symbol that is met outside the vocabulary becomes one, and stands alone."""
        self.number[piece] = k = len(self.pieces)
        self.pieces.append(piece)
        node = self.root
        for i, c in enumerate(piece):
            at, below = node.get(c, (-1, {}))
            node[c] = (k if i + 1 == len(piece) else at, below)
            node = below
        return k

    def agree(self, u: int, t: int) -> bool:
        """Whether token t can follow token u; both by number."""
        key = u << 21 | t
        found = self.agreed.get(key)
        if found is None:
            if len(self.agreed) > MEMO:
                self.agreed.clear()
            a, b = self.pieces[u], self.pieces[t]
            found = self.agreed[key] = merge(self.split(a + b), self.rank) == [a, b]
        return found

    def prefixes(self, text) -> tuple[list[int], list[int]]:
        """For each i, the number of the last token in the encoding of text[:i], and the tokens in it."""
        n = len(text)
        last, count = [-1] * (n + 1), [0] * (n + 1)
        root, agreed, agree = self.root, self.agreed.get, self.agree
        for j in range(n):
            u, c, node, i = last[j], count[j] + 1, root, j
            high = u << 21
            while i < n:
                found = node.get(text[i])
                if found is None:
                    break
                i += 1
                t, node = found
                if t >= 0 and last[i] < 0:
                    if j:
                        ok = agreed(high | t)
                        if ok is None:
                            ok = agree(u, t)
                        if not ok:
                            continue
                    last[i], count[i] = t, c
            if i == j:
                last[j + 1], count[j + 1] = self.add(text[j : j + 1]), c
        return last, count

    def counts(self, text) -> list[int]:
        """Exact number of tokens of every prefix."""
        return self.prefixes(text)[1]

    def encode(self, text) -> list:
        last, out, i = self.prefixes(text)[0], [], len(text)
        while i:
            out.append(self.pieces[last[i]])
            i -= len(out[-1])
        return out[::-1]
