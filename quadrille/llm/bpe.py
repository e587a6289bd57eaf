"""Byte-pair encoding as a left-to-right dynamic programme.

A sequence of tokens is what merging by rank yields exactly if every two neighbours are what merging yields for their joined text.  So each
prefix has one last token: the one that the neighbour rule allows after the prefix it leaves.  That turns encoding into a Viterbi pass with one
backpointer a position, a window of the longest token, and exact token counts at every prefix.
"""

from collections.abc import Iterable
from heapq import heapify, heappop, heappush

import ahocorasick

INF = float("inf")


class Memo(dict):
    """A dict that computes what it lacks and holds so many keys at most: when half as many are new, those before them go, unless asked for since."""

    def __init__(self, fn, bound: int, longest: int = 1 << 30):
        super().__init__()
        self.fn, self.half, self.longest, self.old = fn, bound // 2, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.fn(key)
        if len(key) <= self.longest:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[key] = value


class Bpe:
    """tokens: the vocabulary as strings; rank(a, b): the merge order of two neighbours, None where they don't merge."""

    def __init__(self, tokens, rank, shut=None):
        """shut: from the form of a character at a word's end to that inside a word, if the vocabulary tells the two apart."""
        self.tokens, self.rank = tokens, rank
        self.longest = max(map(len, tokens))
        self.found = self._finder({t: t for t in tokens})
        if shut:
            closed = {t[:-1] + shut[t[-1]]: t for t in tokens if t[-1] in shut}
            both = {t for t in tokens if t[-1] not in shut} | closed.keys()
            self.found_both = self._finder({t: (t if t in tokens else None, closed.get(t)) for t in both})
        self.pairs = Memo(self.neighbours, 1 << 19)
        self.alone = Memo(lambda t: self.merge(t) == [t], 1 << 18)
        self.halves = Memo(self._halves, 1 << 18)
        self.rights = Memo(lambda t: self._edge(t, 1), 1 << 18)
        self.lefts = Memo(lambda t: self._edge(t, 0), 1 << 18)

    @staticmethod
    def _finder(values: dict):
        """Finds the tokens of more than one character in a text: each with its last place, the longest first at each."""
        found = ahocorasick.Automaton()
        for token, value in values.items():
            if len(token) > 1:
                found.add_word(token, value)
        found.make_automaton()
        return found

    def _halves(self, token: str) -> tuple[str, str] | None:
        """The two tokens whose merge made this one."""
        joins: list[int] = []
        return (token[: joins[-1]], token[joins[-1] :]) if self.merge(token, joins) == [token] and joins else None

    def _edge(self, token: str, side: int) -> list[tuple[str, float]]:
        """The tokens that stood at one edge of this token while it was built, last first, each with the rank of the merge that made it."""
        out = []
        while True:
            parts = self.halves[token]
            out.append((token, self.rank(*parts) if parts else -INF))
            if not parts:
                return out
            token = parts[side]

    def neighbours(self, pair: tuple[str, str]) -> bool:
        """Whether merging the joined text leaves these two tokens: at no time while both were built did the tokens at their border merge first.

        Going back in time, the border tokens are undone one by one, latest merge first and, of equal ranks, the right one first.
        """
        if not (self.alone[pair[0]] and self.alone[pair[1]]):
            return False
        xs, ys = self.rights[pair[0]], self.lefts[pair[1]]
        i = j = 0
        end_x = end_y = INF
        while True:
            (x, made_x), (y, made_y) = xs[i], ys[j]
            if (r := self.rank(x, y)) is not None and r < end_x and r <= end_y:
                return False
            if made_x > made_y:
                i, end_x = i + 1, made_x
            elif made_y > -INF:
                j, end_y = j + 1, made_y
            else:
                return True

    def merge(self, text: str, joins: list[int] | None = None) -> list[str]:
        """The tokens by repeatedly joining the best-ranked pair, leftmost first: the definition, and the way for runs with tied ranks.

        joins: gets the place of each merge.
        """
        n, part = len(text), list(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 1, part[i], part[i + 1]) for i in range(n - 1) if (r := self.rank(part[i], part[i + 1])) is not None]
        heapify(heap)
        while heap:
            _, i, j, a, b = heappop(heap)
            if part[i] != a or j >= n or part[j] != b or after[i] != j:
                continue
            part[i], part[j], after[i] = a + b, "", after[j]
            if joins is not None:
                joins.append(j)
            if after[j] < n:
                before[after[j]] = i
                if (r := self.rank(part[i], part[after[i]])) is not None:
                    heappush(heap, (r, i, after[i], part[i], part[after[i]]))
            if (h := before[i]) >= 0 and (r := self.rank(part[h], part[i])) is not None:
                heappush(heap, (r, h, i, part[h], part[i]))
        return [p for p in part if p]

    def stream(self, text: str):
        """The tokens of text, in order, as lists: each is committed once all surviving backpointer paths agree on the boundary after it.

        Kept are the last tokens of the prefixes that end after the last such boundary; a new token looks back over the longest token's length at most.
        """
        pairs, alone, longest = self.pairs, self.alone, self.longest
        last, done, due = [""], 0, 2 * longest  # last[k]: the last token of the prefix of done + k characters
        at = 0  # prefixes of so many characters are done; where no longer token can be the last one of a prefix, its last character is
        for end, token in self.found.iter(text):
            while at < end:
                last.append(text[at])
                at += 1
                if len(last) > due:
                    common = self._agreed(last)
                    yield self._path(last, common)
                    del last[:common]
                    done += common
                    due = len(last) + longest
            if at == end and (size := len(token)) <= len(last):
                before = last[-size]
                if pairs[before, token] if before else alone[token]:
                    last.append(token)
                    at += 1
        last.extend(text[at:])
        yield self._path(last, len(last) - 1)

    def _agreed(self, last: list[str]) -> int:
        """The latest position that all paths pass which a later token can go on from: they are followed back, the latest first, until one is left."""
        alive = set(range(len(last) - self.longest, len(last)))
        while len(alive) > 1:
            top = max(alive)
            alive.remove(top)
            alive.add(top - len(last[top]))
        return alive.pop()

    @staticmethod
    def _path(last: list[str], end: int) -> list[str]:
        out = []
        while end > 0:
            out.append(last[end])
            end -= len(last[end])
        return out[::-1]

    def counts(self, texts: Iterable[str]):
        """For each of texts (in order, so that neighbours begin alike) the token counts of all its prefixes, from the empty one on, each taken to end where a word
        ends.  What a text shares with the one before it is not gone over again."""
        pairs, alone, longest = self.pairs, self.alone, self.longest
        last, inside, out, known = [""], [0], [0], ""
        for text in texts:
            same = 0
            for a, b in zip(text, known):
                if a != b:
                    break
                same += 1
            del last[same + 1 :], inside[same + 1 :], out[same + 1 :]
            known, at, shut = text, same, same  # prefixes of so many characters have their last token, and their count
            for end, (token, closing) in self.found_both.iter(text, max(0, same + 1 - longest)):
                if end < same:
                    continue
                while at < end:
                    last.append(text[at])
                    inside.append(inside[-1] + 1)
                    at += 1
                while shut < end:
                    out.append(inside[shut] + 1)
                    shut += 1
                if closing and shut == end:
                    size = len(closing)
                    before = last[end + 1 - size]
                    if pairs[before, closing] if before else alone[closing]:
                        out.append(inside[end + 1 - size] + 1)
                        shut += 1
                if token and at == end:
                    size = len(token)
                    before = last[-size]
                    if pairs[before, token] if before else alone[token]:
                        last.append(token)
                        inside.append(inside[-size] + 1)
                        at += 1
            for char in text[at:]:
                last.append(char)
                inside.append(inside[-1] + 1)
            while shut < len(text):
                out.append(inside[shut] + 1)
                shut += 1
            yield out
