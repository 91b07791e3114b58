"""License scans with a generalised suffix automaton of license tokens.

The automaton holds all words of all templates; reading a text's words through it
gives the matching statistics: at each word the longest run of words, ending
there, that occurs in some template; the state and its suffixes know all places of
the run and of its ends.  Maximal runs of CHAIN_WORDS words or more, at every place
of every template, are chained by template, in order of text and template, into
covered spans; each word of a text counts once, for the chain that explains most
words.  A template is found when a chain covers enough of it and stands out from its
rivals: where a chain of another label explains as many words of the same stretch,
the text doesn't tell them apart, and only a template that is covered whole, or
nearly, and more so than its rivals, gives its label.  Short phrases are runs too: a phrase ends at a word where the statistics reach
the phrase's state.

Only words that follow each other in some template can start or extend a run, so a
text is cut at all other words first, and just the pieces left are read.

Defined cases: a null text is empty; repeated rows each get their own result; other
columns pass through.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import free_name, prepare
from .kernels import ALNUM, Words, slices
from .license_texts import PHRASES, TEMPLATES

CHAIN_WORDS = 6
#: Share of a template that its chain covers when it is found, and when it is covered whole; words of text between two runs of a chain at most.
COVERED, WHOLE, GAP = 0.5, 0.95, 12


def word_hashes(text: str) -> np.ndarray:
    body = np.frombuffer(text.encode(), np.uint8)
    return Words(body, np.array([0, len(body)]), ALNUM).hashes()


class SuffixAutomaton:
    """Of several token sequences; a state knows all places of its runs: template and end."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for number, tokens in enumerate(sequences):
            last = 0
            for token in tokens:
                last = self._extend(last, token)
        self.places: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for number, tokens in enumerate(sequences):
            state = 0
            for at, token in enumerate(tokens):
                up = state = self.next[state][token]
                while up > 0:
                    self.places[up].append((number, at + 1))
                    up = self.link[up]

    def _state(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _clone(self, p: int, q: int, token: int) -> int:
        """A state for the runs of q that reach it from p and p's suffixes."""
        made = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = made
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = made
            p = self.link[p]
        return made

    def _extend(self, last: int, token: int) -> int:
        q = self.next[last].get(token)
        if q is not None:  # an earlier sequence has this run
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, token)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][token]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, token)
        return new

    def step(self, state: int, length: int, token: int) -> tuple[int, int]:
        """The matching statistics after one more token."""
        while state and token not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        to = self.next[state].get(token)
        return (to, length + 1) if to is not None else (0, 0)

    def state_of(self, tokens: list[int]) -> int:
        state = 0
        for token in tokens:
            state = self.next[state][token]
        return state


class Scanner:
    """The automaton of templates and phrases."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        self.labels, self.phrase_labels = [label for label, _ in templates], [label for _, label in phrases]
        texts = [word_hashes(t) for _, t in templates] + [word_hashes(p) for p, _ in phrases]
        self.vocabulary = np.unique(np.concatenate(texts))
        coded = [np.searchsorted(self.vocabulary, t).tolist() for t in texts]
        self.sizes = [len(c) for c in coded[: len(templates)]]
        self.automaton = SuffixAutomaton(coded)
        n = len(self.vocabulary)
        self.pairs = np.unique(np.array([a * n + b for c in coded for a, b in zip(c, c[1:])], np.int64))
        # phrases that end at a state: those of its suffixes, and itself from the phrase's length on
        self.least = min(len(c) for c in coded[len(templates) :])
        home = {}
        for i, c in enumerate(coded[len(templates) :]):
            home.setdefault(self.automaton.state_of(c), []).append((i, len(c)))
        self.ends: list[list[tuple[int, int]]] = []
        # places in templates where a state's run or an end of it, CHAIN_WORDS long at least, stands: (template, end) and the words that fit there
        self.stands: list[dict[tuple[int, int], int]] = []
        for state in range(len(self.automaton.next)):
            found, stands, at = [], {}, state
            while at > 0:
                found += home.get(at, [])
                if self.automaton.length[at] >= CHAIN_WORDS:
                    for place in self.automaton.places[at]:
                        if place[0] < len(templates):
                            stands.setdefault(place, self.automaton.length[at])
                at = self.automaton.link[at]
            self.ends.append(found)
            self.stands.append(stands)

    def read(self, tokens: list[int]):
        """(phrases: (first word, phrase)), (maximal long runs, at every place: (first word, words, template, first template word))."""
        machine, state, length = self.automaton, 0, 0
        phrases, runs = [], []
        live: dict[tuple[int, int], int] = {}  # words of the runs that end here, by template and its lead over the text

        def close(end, going):
            for (template, lead), n in live.items():
                if (template, lead) not in going:
                    runs.append((end - n, n, template, end + lead - n))

        for at, token in enumerate(tokens):
            state, length = machine.step(state, length, token)
            now = {(t, end - at - 1): min(n, length) for (t, end), n in self.stands[state].items()} if length >= CHAIN_WORDS else {}
            close(at, now)
            live = now
            for phrase, size in self.ends[state]:
                if length >= size:
                    phrases.append((at - size + 1, phrase))
        close(len(tokens), ())
        return phrases, runs

    def chains(self, runs: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, float, bool]]:
        """(template, first word, word after the last, covered share, whether it gives its label) of chained runs, the most covered first.

        The chain of any template that explains most words takes these words of the text,
        and so on with the words that are left.
        """
        out = []
        while runs:
            owner: dict[int, int] = {}
            taken: list[tuple[int, float, int, tuple[int, int], list[float]]] = []  # words, share, template, stretch, shares of rivals
            for words, share, template, pieces in self._best(runs):
                own = [w for first, end in pieces for w in range(first, end)]
                met = [owner[w] for w in own if w in owner]
                if not met:
                    owner.update(dict.fromkeys(own, len(taken)))
                    taken.append((words, share, template, (pieces[0][0], pieces[-1][1]), []))
                else:
                    chain = taken[max(set(met), key=met.count)]
                    if chain[0] == words and 2 * len(met) >= words and self.labels[template] != self.labels[chain[2]]:
                        chain[4].append(share)
            for _, share, template, (first, end), rivals in taken:
                stands = share >= COVERED and (not rivals or share >= WHOLE and share > max(rivals))
                out.append((template, first, end, share, stands))
            runs = [left for run in runs for left in self._unused(run, owner)]
        return sorted(out, key=lambda s: (-s[3], s))

    def _best(self, runs):
        """(words, covered share, template, pieces (first word, end)) of the best chain that ends with each run, most words first."""
        runs = sorted(runs, key=lambda r: (r[2], r[0] + r[1], r))
        words, cut, before = [r[1] for r in runs], [0] * len(runs), [-1] * len(runs)
        for i, (first, n, template, place) in enumerate(runs):
            j = i - 1
            while j >= 0 and runs[j][2] == template and first - (end := runs[j][0] + runs[j][1]) <= GAP:
                # words of the text and of the template count once
                both = max(0, end - first, runs[j][3] + runs[j][1] - place)
                if both < n and words[j] + n - both > words[i]:
                    words[i], cut[i], before[i] = words[j] + n - both, both, j
                j -= 1
        share = [w / self.sizes[r[2]] for w, r in zip(words, runs)]
        for i in sorted(range(len(runs)), key=lambda i: (-words[i], -share[i], i)):
            pieces, at = [], i
            while at >= 0:
                pieces.append((runs[at][0] + cut[at], runs[at][0] + runs[at][1]))
                at = before[at]
            yield words[i], share[i], runs[i][2], pieces[::-1]

    @staticmethod
    def _unused(run, used: dict[int, int]):
        """The parts of a run, CHAIN_WORDS long at least, whose words are not used."""
        first, n, template, place = run
        start = first
        for w in range(first, first + n + 1):
            if w == first + n or w in used:
                if w - start >= CHAIN_WORDS:
                    yield start, w - start, template, place + start - first
                start = w + 1

    def scan(self, words: Words):
        """{row: (phrases, spans)} of the rows with anything found; phrases and spans in words of the row."""
        hashes, row = words.hashes(), words.row_of_word()
        if len(hashes) < self.least:
            return {}
        code = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        known = self.vocabulary[code] == hashes
        pair = np.flatnonzero(known[:-1] & known[1:] & (row[:-1] == row[1:]))
        pair = pair[np.isin(code[pair].astype(np.int64) * len(self.vocabulary) + code[pair + 1], self.pairs)]
        if not len(pair):
            return {}
        first = np.flatnonzero(np.append(True, np.diff(pair) != 1))
        last = np.append(first[1:], len(pair)) - 1
        long = pair[last] - pair[first] + 2 >= self.least
        found: dict[int, tuple[list, list]] = {}
        for a, b in zip(pair[first[long]].tolist(), (pair[last[long]] + 2).tolist()):
            phrases, runs = self.read(code[a:b].tolist())
            if phrases or runs:
                r = int(row[a])
                shift = a - int(words.rows[r])
                own = found.setdefault(r, ([], []))
                own[0].extend((w + shift, p) for w, p in phrases)
                own[1].extend((w + shift, n, t, f) for w, n, t, f in runs)
        return {r: (phrases, self.chains(runs)) for r, (phrases, runs) in found.items()}


@functools.cache
def _scanner() -> Scanner:
    return Scanner()


_SPAN = T.StructType([T.StructField("label", T.StringType()), T.StructField("first", T.LongType()), T.StructField("end", T.LongType()), T.StructField("covered", T.DoubleType()), T.StructField("stands", T.BooleanType())])
_RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("phrases", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("label", T.StringType())]))),
        T.StructField("spans", T.ArrayType(_SPAN)),
    ]
)
_ARROW = pa.struct(
    [
        ("n_words", pa.int64()),
        ("phrases", pa.list_(pa.struct([("first", pa.int64()), ("label", pa.string())]))),
        ("spans", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("covered", pa.float64()), ("stands", pa.bool_())]))),
    ]
)


def scan_licenses(docs: DataFrame, *, text: str = "text") -> tuple[DataFrame, str]:
    """docs with a struct (n_words, phrases (first, label), spans (label, first, end, covered, stands)), and its name."""
    prepare(docs.sparkSession)
    name, at = free_name(docs, "licenses"), docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, _RESULT)])

    def run(batches):
        scanner = _scanner()
        for batch in batches:
            rows = []
            for low, high, body, offsets in slices(batch.column(at)):
                words = Words(body, offsets, ALNUM)
                found = scanner.scan(words)
                for i, n in enumerate(words.counts.tolist()):
                    phrases, spans = found.get(i, ((), ()))
                    rows.append({"n_words": n, "phrases": [{"first": w, "label": scanner.phrase_labels[p]} for w, p in sorted(phrases)], "spans": [{"label": scanner.labels[t], "first": a, "end": b, "covered": c, "stands": d} for t, a, b, c, d in spans]})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, _ARROW)], names=schema.names)

    return docs.mapInArrow(run, schema), name
