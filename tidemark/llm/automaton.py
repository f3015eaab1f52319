"""A generalised suffix automaton over sequences of words."""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Sequence


class SuffixAutomaton:
    """Every run of words of the sequences added so far.

    A state stands for runs that end at the same places; ``length`` is its longest run, ``link`` the
    state of the longest suffix that ends at more places.
    """

    def __init__(self, sequences: Iterable[Sequence[Hashable]] = ()):
        self.steps: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        for sequence in sequences:
            self.add(sequence)

    def _state(self, length: int, steps: dict, link: int) -> int:
        self.steps.append(steps)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _copy(self, source: int, word: Hashable, target: int) -> int:
        """Split off the runs of ``target`` that are no longer than one more than ``source``."""
        part = self._state(self.length[source] + 1, dict(self.steps[target]), self.link[target])
        self.link[target] = part
        while source >= 0 and self.steps[source].get(word) == target:
            self.steps[source][word] = part
            source = self.link[source]
        return part

    def add(self, sequence: Sequence[Hashable]) -> list[int]:
        """Take in a sequence; gives the state after each of its words."""
        last, path = 0, []
        for word in sequence:
            target = self.steps[last].get(word)
            if target is not None:
                if self.length[target] != self.length[last] + 1:
                    target = self._copy(last, word, target)
                last = target
            else:
                new = self._state(self.length[last] + 1, {}, 0)
                state = last
                while state >= 0 and word not in self.steps[state]:
                    self.steps[state][word] = new
                    state = self.link[state]
                if state >= 0:
                    target = self.steps[state][word]
                    if self.length[target] != self.length[state] + 1:
                        target = self._copy(state, word, target)
                    self.link[new] = target
                last = new
            path.append(last)
        return path

    def matching(self, sequence: Sequence[Hashable]) -> list[int]:
        """For each word, the length of the longest run ending there that the automaton knows."""
        state = length = 0
        found = []
        for word in sequence:
            target = self.steps[state].get(word)
            while target is None and state:
                state = self.link[state]
                length = self.length[state]
                target = self.steps[state].get(word)
            if target is not None:
                state, length = target, length + 1
            found.append(length)
        return found
