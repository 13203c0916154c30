"""Toxicity scores on text restored by a noisy-channel decoder.

A token that doesn't look like a word (digits or signs between letters, doubled
or drawn out letters) becomes a lattice: each sign may stand for itself, for
letters it resembles, or for nothing, and a run of one letter for one or two of
it.  Each sign of a run of masks may be a letter of its own, with which a known word goes on.  A run of short
tokens (``SHORT`` signs at most) is one lattice, in which each space may be dropped
or kept as the border of a word; borders between tokens of any length may be
dropped where the tokens begin a known word together.  Viterbi search under a
character language model of order three, which frequent words of labelled texts
raise to their own frequency, picks what was meant, whatever the length.  Only
tokens without a letter or a sign like one, and numbers with their marks, are
left as they are.  Restored words and their beginnings are then looked up in a
table of evidence learned from labels.
"""

from __future__ import annotations

import itertools
import re
import uuid
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import crc_mod, durable, forget, tidy
from leafmill.llm.textnp import LOWER, buffers, slices

# What signs are commonly written for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
}
#: Signs that make a token without letters a word to decode, unless it is a number or has no other sign.
LIKE = frozenset("@$!€£¡")
MASKS, SEPARATORS = "*#_?", ".-_*~'"
#: Natural-log costs: reading a sign as a letter, as nothing (four times that where it resembles a letter),
#: a separator as nothing, a run as shorter than written, and a doubled letter as one.
COST_LEET, COST_DROP, COST_HUSH, COST_RUN, COST_TWICE = 0.4, 1.0, 0.2, 0.3, 4.5
#: Costs of a mask as the letter with which a known word goes on: the first of a run, and further ones; of a sign of a run of masks as nothing.
COST_MASKS, COST_BARE = (1.0, 0.4), 0.8
#: Costs of a space as nothing: between single signs, next to one, and between longer tokens; signs of a short token.
COST_JOIN, SHORT = (0.2, 1.5, 4.0), 3
#: Lengths of the beginnings of words that carry evidence, and words kept in a worker's memo (a memory bound).
PREFIXES, MEMO = (3, 4, 5, 6), 150_000
#: Pairs of a word and the one before it that a task holds at once (a memory bound; the shuffle tells equal ones).
PAIRS = 200_000
#: The part of other texts (one in so many) whose contexts rule out most of what is no evidence before all of them are read.
PARTS = 6
#: Labelled rows, counted first, whose keys are broadcast; more are joined by a shuffle of the texts.
KEYS = 1_000_000
#: Frequent words that the decoder knows.
WORDS = 20_000
#: Standard errors taken off the log odds, and the least evidence that is kept.
ERRORS, LEAST = 1.0, 3.0

LETTER_RUN = re.compile(r"[^\W\d_]+")
LETTERS = re.compile(r"[^\W\d_]+\Z")
TWICE = re.compile(r"(.)\1+")
SAME = re.compile(r"(.)\1*")
#: Short tokens side by side, in a string that has a 1 for each short token.
MANY = re.compile(b"\1{2,}")
#: A number with the marks around it and in it: no word, whatever its signs resemble.
NUMBER = re.compile(r"[^\w]*\d[\d.,:;/\-+x×]*[^\w]*\Z")
LEADING, TRAILING = re.compile(r"\**\Z"), re.compile(r"[*#]*")
EDGE = re.compile(r"^[\s\"'()\[\]{}%&.,;:?*#~\-]+|[^\w]+\Z")

#: Symbols of the character model: 0 for anything that isn't part of a word, a-z, and bytes from 0x80 by their low 6 bits.
SYMBOL = np.zeros(256, dtype="i4")
SYMBOL[97:123] = np.arange(1, 27)
SYMBOL[128:] = 27 + (np.arange(128) & 63)
SYMBOLS = SYMBOL.tolist()
SIZE = 91


@dataclass
class Model:
    """logp: cube of log probabilities by symbol; evidence: weight of "=word" and "prefix"; coef: of the final regression;
    gain: of frequent words, log probability over that of their characters."""

    logp: np.ndarray
    evidence: dict[str, float] = field(default_factory=dict)
    coef: np.ndarray = field(default_factory=lambda: np.zeros(4))
    gain: dict[str, float] = field(default_factory=dict)


def char_counts(column: pa.Array) -> np.ndarray:
    """Counts of runs of three symbols over whole texts."""
    total = np.zeros(SIZE**3, "i8")
    buf, offsets = buffers(column)
    for i, j in slices(offsets, 1 << 20):
        s = SYMBOL[LOWER[buf[offsets[i] : offsets[j]]]]
        if len(s) > 2:
            total += np.bincount((s[:-2] * SIZE + s[1:-1]) * SIZE + s[2:], minlength=SIZE**3)
    return total


def char_model(counts: np.ndarray) -> np.ndarray:
    """Interpolated log probabilities of a symbol after two others."""
    three = counts.reshape(SIZE, SIZE, SIZE).astype("f8")
    two, one = three.sum(0), three.sum((0, 1))
    p = (one + 0.5) / (one.sum() + 0.5 * SIZE)
    p = (two + 5 * p) / (two.sum(1, keepdims=True) + 5)
    return np.log((three + 5 * p[None]) / (three.sum(2, keepdims=True) + 5)).astype("f4")


def gains(counts: dict[str, int], logp: np.ndarray) -> dict[str, float]:
    """Of each word that is likelier than its characters, by how much."""
    total = sum(counts.values())
    out = {}
    for word, n in counts.items():
        s = np.concatenate([[0, 0], SYMBOL[np.frombuffer(word.encode(), "u1")], [0]])
        gain = float(np.log(n / total) - logp[s[:-2], s[1:-1], s[2:]].sum())
        if gain > 0:
            out[word] = gain
    return out


class Restorer:
    """Restores words and weighs texts with a model; one for each task."""

    def __init__(self, model: Model):
        self.model = model
        self.memo: dict[str, str] = {}
        self.segments: dict[str, list[str]] = {}
        self.weights: dict[str, tuple[str, float]] = {}
        self.symbols: dict[str, list[int]] = {}
        self.logp = array("f", np.ascontiguousarray(model.logp, "f4").tobytes())
        self.gain = model.gain
        self.begun = {w[:n] for w in model.gain for n in range(1, len(w) + 1)}
        #: Letters with which a known word goes on after each beginning.
        self.next: dict[str | None, set[str]] = {}
        for w in model.gain:
            for n in range(len(w)):
                self.next.setdefault(w[:n], set()).add(w[n])
        self.runs: dict[str, dict[str, float]] = {}
        self.logs: dict[str, float] = {}
        #: Beginnings of known words that carry evidence.
        self.heard = {w[:n] for w in model.gain if self.weight(w) for n in range(1, len(w) + 1)}
        self.parts = {w[m:n] for w in model.gain if self.weight(w) for m in range(1, len(w)) for n in range(m + 1, len(w) + 1)}
        #: Beginnings of evidence, repeats of a letter taken as one.
        self.starts = {TWICE.sub(r"\1", f.removeprefix("=")[: max(PREFIXES)]) for f in model.evidence}
        self.sizes = sorted({len(f) for f in self.starts})
        #: First two letters of tokens that may begin with evidence, and first ones where one letter is enough.
        self.openings = {f[:2] for f in self.starts} | {f[:1] * 2 for f in self.starts}
        self.initials = {f for f in self.starts if len(f) < 2}

    def _step(self, paths: dict, text: str, cost: float, out: dict) -> None:
        """Paths by last two symbols and the word so far (None where no frequent word begins so)."""
        logp, symbols = self.logp, self.symbols.get(text)
        if symbols is None:
            symbols = [int(SYMBOL[b]) for b in text.encode()]
            if len(self.symbols) < 10_000:  # a memory bound
                self.symbols[text] = symbols
        for (a, b, w), (score, word) in paths.items():
            s = score - cost
            x, y = a, b
            for z in symbols:
                s += logp[(x * SIZE + y) * SIZE + z]
                x, y = y, z
            if text == " ":
                s, w = s + self.gain.get(w, 0.0), ""
            elif text and w is not None and (w := w + text) not in self.begun:
                w = None
            known = out.get((x, y, w))
            if known is None or known[0] < s:
                out[x, y, w] = (s, (word, text))

    def _mask(self, paths: dict, k: int, run: int, c: str) -> dict:
        """Paths over sign k of a run of masks: a letter with which a known word goes on, or nothing."""
        out: dict = {}
        for at, entry in paths.items():
            one = {at: entry}
            for letter in self.next.get(at[2], ()):
                self._step(one, letter, COST_MASKS[k > 0], out)
        self._step(paths, "", COST_BARE if run > 1 else COST_HUSH if c in SEPARATORS else COST_DROP, out)
        return out

    def _spelled(self, parts: tuple[tuple[str, float], ...]) -> tuple[float, str]:
        """Log probability of a word put together from parts with their costs, and the word."""
        logp, at, s = self.logp, 0, 0.0
        for text, cost in parts:
            s -= cost
            for b in text.encode():
                z = SYMBOLS[b]
                s += logp[at * SIZE + z]
                at = (at * SIZE + z) % SIZE**2
        word = "".join(p[0] for p in parts)
        return s + logp[at * SIZE] + self.gain.get(word, 0.0), word

    def viterbi(self, token: str) -> str:
        """The likeliest word behind a token."""
        return self.decode(token)[1]

    def decode(self, token: str) -> tuple[float, str]:
        """The likeliest word behind a token, or words behind some with spaces, and its log probability."""
        if LETTERS.match(token):
            parts = [((c, 0.0),) if run == 1 else ((c, COST_TWICE), (c * 2, 0.0)) if run == 2 else ((c, COST_RUN), (c * 2, COST_RUN)) for c, run in ((m[0][0], len(m[0])) for m in SAME.finditer(token))]
            if sum(len(p) > 1 for p in parts) <= 4:  # few ways: each by itself, to the same sums
                return max((self._spelled(p) for p in itertools.product(*parts)), key=lambda p: p[0])
        paths: dict = {(0, 0, ""): (0.0, None)}
        i = 0
        while i < len(token):
            c, j = token[i], i + 1
            while j < len(token) and token[j] == c:
                j += 1
            run = j - i
            out: dict = {}
            if LETTERS.match(c):
                for n in (1, 2)[:run]:
                    self._step(paths, c * n, 0.0 if n == run else COST_TWICE if run == 2 else COST_RUN, out)
            elif c == " ":
                left, right = i > 1 and token[i - 2] != " ", token[i + 2 : i + 3] not in ("", " ")
                self._step(paths, " ", 0.0, out)
                self._step(paths, "", COST_JOIN[left + right], out)
            elif c in MASKS:
                for k in range(run):
                    paths = out = self._mask(paths, k, run, c)
            else:
                for letter in LEET.get(c, ""):
                    for n in {1, min(2, run)}:
                        self._step(paths, letter * n, COST_LEET * n + COST_RUN * (run > n), out)
                if not c.isdigit():
                    self._step(paths, "", COST_HUSH if c in SEPARATORS else COST_DROP * (4 if c in LEET else 1), out)
                if " " in token and c.isdigit():  # a number among short tokens
                    self._step(paths, c * run, 0.0, out)
                if not out:
                    self._step(paths, "", 2 * COST_DROP, out)
            paths, i = out, j
        score, (_, word) = max(((s + self.logp[(a * SIZE + b) * SIZE] + self.gain.get(w, 0.0), (s, word)) for (a, b, w), (s, word) in paths.items()), key=lambda p: p[0])
        texts = []
        while word is not None:
            word, text = word
            texts.append(text)
        return score, "".join(reversed(texts))

    def core(self, token: str) -> str:
        """A token without the marks at its ends; masks on one side of a word that lacks letters there stay."""
        core = EDGE.sub("", token)
        if "*" not in token and "#" not in token or not any(map(str.isalpha, core)):
            return core
        at = token.find(core)
        lead, trail = LEADING.search(token[:at])[0], TRAILING.match(token[at + len(core) :])[0]
        return core if lead and trail else lead + core + trail  # on both sides they are emphasis

    def restore(self, token: str) -> str:
        """A lower-case token as the word it was meant to be; words stay as they are."""
        core = token if token.isalpha() else self.core(token)
        if LETTERS.match(core):
            return self.viterbi(core) if TWICE.search(core) else core
        if any(map(str.isalpha, core)):
            return self.viterbi(core)
        # Signs at the edge may be letters too where nothing else is one ("@$$").
        signs = set(token)
        return self.viterbi(token) if signs & LIKE and len(signs & LEET.keys()) > 1 and not NUMBER.match(token) else core

    def weight(self, word: str) -> float:
        e = self.model.evidence
        best = e.get("=" + word, 0.0)
        for n in PREFIXES:
            if len(word) >= n:
                w = e.get(word[:n], 0.0)
                if w > best:
                    best = w
        return best

    def look(self, token: str) -> str:
        if len(self.memo) >= MEMO:
            self.memo.clear()
        found = self.memo[token] = self.restore(token)
        return found

    def segment(self, run: str) -> list[str]:
        """The words behind a run of short tokens: one lattice over all of them."""
        found = self.segments.get(run)
        if found is None:
            found = self._segment(run)
            if len(run) <= 40:  # a memory bound
                if len(self.segments) >= MEMO:
                    self.segments.clear()
                self.segments[run] = found
        return found

    def _segment(self, run: str) -> list[str]:
        cores = [(self.core(p) or (p if p in LIKE else "")) for p in run.split()]
        token = " ".join(filter(None, cores))
        if not any(map(str.isalpha, token)):
            return token.split()
        return self.viterbi(token).split()

    def words(self, text: str) -> list[str]:
        """The words of a whole text, in order.

        Tokens that are a known word together, one of them longer than ``SHORT``,
        are put together where that is likelier, and what short tokens are left
        side by side is decoded as runs.
        """
        memo, look, begun = self.memo, self.look, self.begun
        tokens = text.lower().split()
        words = [look(t) if (w := memo.get(t)) is None else w for t in tokens]
        out: list[str] = []
        begin = i = 0  # the run of short tokens before place i begins at ``begin``
        while i < len(tokens):
            n = self.joined(words, i, begun) if words[i] in begun and i + 1 < len(words) and words[i] + words[i + 1] in begun else 1
            if n > 1 and self.parted(tokens, words, begin, i, n):
                out += [*self.run(tokens, words, begin, i), "".join(words[i : i + n])]
                begin = i = i + n
            elif len(tokens[i]) <= SHORT:
                i += 1
            else:
                if begin < i:
                    out += self.run(tokens, words, begin, i)
                out.append(words[i])
                begin = i = i + 1
        return out + self.run(tokens, words, begin, i)

    def run(self, tokens: list[str], words: list[str], i: int, j: int) -> list[str]:
        """The words of the short tokens from place i to j."""
        return self.segment(" ".join(tokens[i:j])) if j - i > 1 else words[i:j]

    def parted(self, tokens: list[str], words: list[str], begin: int | None, i: int, n: int) -> bool:
        """Whether the n tokens at place i are likelier one word than what they are in the runs of short tokens at either side."""
        short = [len(t) <= SHORT for t in tokens[i : i + n]]
        if all(short):
            return False  # the run's own lattice tells
        first, last = i, i + n
        if short[0]:
            first = self.since(tokens, i) if begin is None else begin
        while short[-1] and last < len(tokens) and len(tokens[last]) <= SHORT:
            last += 1

        def likely(a: int, z: int) -> float:
            cores = [c for t in tokens[a:z] if (c := self.core(t))]
            return self.decode(" ".join(cores))[0] if len(cores) > 1 and any(map(str.isalpha, "".join(cores))) else sum(map(self.log, words[a:z]))

        apart, a = 0.0, first
        while a < last:
            z = a + 1
            while len(tokens[a]) <= SHORT and z < last and len(tokens[z]) <= SHORT:
                z += 1
            apart += likely(a, z)
            a = z
        cost = sum(COST_JOIN[(len(x) > 1) + (len(y) > 1)] for x, y in itertools.pairwise(words[i : i + n]))
        return likely(first, i) + self.log("".join(words[i : i + n])) - cost + likely(i + n, last) > apart

    def log(self, word: str) -> float:
        """Log probability of a word between spaces."""
        found = self.logs.get(word)
        if found is None:
            if len(self.logs) >= MEMO:
                self.logs.clear()
            s = [0, 0, *(int(SYMBOL[b]) for b in word.encode()), 0]
            found = self.logs[word] = sum(self.logp[(a * SIZE + b) * SIZE + z] for a, b, z in zip(s, s[1:], s[2:], strict=False)) + self.gain.get(word, 0.0)
        return found

    @staticmethod
    def since(tokens: list[str], i: int) -> int:
        """Where the run of short tokens before place i begins."""
        while i and len(tokens[i - 1]) <= SHORT:
            i -= 1
        return i

    def joined(self, words: list[str], i: int, begun: set[str]) -> int:
        """How many words from place i on are one known word that was parted, by the likelier reading; 1 if none are."""
        word, n, best, gain = words[i], 1, 1, 0.0
        apart, cost = None, 0.0
        while word in begun and i + n < len(words) and (longer := word + words[i + n]) in begun:
            if apart is None:
                apart = self.log(word)
            cost += COST_JOIN[(len(words[i + n - 1]) > 1) + (len(words[i + n]) > 1)]
            apart += self.log(words[i + n])
            word, n = longer, n + 1
            if word in self.gain and (more := self.log(word) - cost - apart) > gain:
                best, gain = n, more
        return best

    def restored(self, text: str) -> str:
        """The whole text with every token restored."""
        return " ".join(self.words(text))

    def weigh(self, token: str) -> tuple[str, float]:
        """``look``, but a word of letters that begins like no word with evidence isn't decoded."""
        if len(self.weights) >= MEMO:
            self.weights.clear()
        core = self.core(token)
        if core.isalpha():
            flat = TWICE.sub(r"\1", core)
            if not any(flat[:n] in self.starts for n in self.sizes):
                found = self.weights[token] = (core, 0.0)
                return found
        word = self.restore(token)
        found = self.weights[token] = (word, self.weight(word))
        return found

    def evident(self, run: str) -> dict[str, float]:
        """Words with evidence behind a run of short tokens.

        Words are pieces of the run with fewer repeats of a letter at most, so a run
        of letters none of whose pieces begins a word with evidence isn't decoded.
        """
        joined = "".join(EDGE.sub("", p) for p in run.split())
        if joined.isalpha():
            flat = TWICE.sub(r"\1", joined)
            if not any(flat[i : i + n] in self.starts for n in self.sizes for i in range(len(flat) - n + 1)):
                return {}
        return {w: e for w in self.segment(run) if (e := self.weight(w))}

    def features(self, text: str) -> tuple[float, float, float]:
        """Strongest evidence, sum of evidence of distinct words, and distinct words with evidence for each 100 tokens."""
        weights, weigh, runs, heard, parts = self.weights, self.weigh, self.runs, self.heard, self.parts
        openings, initials = self.openings, self.initials
        tokens = text.lower().split()
        hits: dict[str, float] = {}
        alone: set[str] = set()
        last = 0
        for m in MANY.finditer(bytes(map(SHORT.__ge__, map(len, tokens)))):
            alone.update(tokens[last : m.start()])
            last = m.end()
            run = " ".join(tokens[m.start() : last])
            found = runs.get(run)
            if found is None:
                found = self.evident(run)
                if len(run) <= 40:  # a memory bound
                    if len(runs) >= MEMO:
                        runs.clear()
                    runs[run] = found
            if found:
                hits.update(found)
        alone.update(tokens[last:])
        # Tokens with which a known word with evidence may begin, or go on.
        begin, go_on = {}, {}
        for t in set(tokens):
            word = t.rstrip(".,;:")
            if word[:2] in openings or word[:1] in initials or not word.isalpha():
                word, w = weights.get(t) or weigh(t)
                if w and t in alone:
                    hits[word] = w
            if word in heard:
                begin[t] = word
            if word in parts:
                go_on[t] = word
        if begin and go_on:
            for i, t in enumerate(tokens):
                if t in go_on and i and tokens[i - 1] in begin and begin[tokens[i - 1]] + go_on[t] in heard:
                    self._together(tokens, i - 1, hits)
        if not hits:
            return 0.0, 0.0, 0.0
        return max(hits.values()), float(np.log1p(sum(hits.values()))), min(5.0, 100.0 * len(hits) / len(tokens))

    def _together(self, tokens: list[str], i: int, hits: dict[str, float]) -> None:
        """Adds the evidence of a word that was parted into the tokens from place i on."""
        first, last = self.since(tokens, i), i + 2 + max(map(len, self.heard))
        while last < len(tokens) and len(tokens[last]) <= SHORT:
            last += 1  # a run of short tokens is weighed whole
        near = tokens[first:last]
        words = [(self.weights.get(t) or self.weigh(t))[0] for t in near]
        if (n := self.joined(words, i - first, self.heard)) > 1 and self.parted(near, words, 0, i - first, n):
            word = "".join(words[i - first : i - first + n])
            if w := self.weight(word):
                hits[word] = w

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([self.features(t or "") for t in texts]).reshape(len(texts), 3)
        z = self.model.coef[0] + x @ self.model.coef[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


#: The restorer of a worker by the number of its broadcast model: what it has looked up serves the worker's next tasks.
LAST: dict[str, Restorer] = {}


def restorer(model: Model, number: str) -> Restorer:
    """The restorer of this worker for a model, one at a time."""
    if number not in LAST:
        LAST.clear()
        LAST[number] = Restorer(model)
    return LAST[number]


def logistic(rows: DataFrame, x: list[str], y: str, weight: str, ridge: float = 0.05) -> np.ndarray:
    """Coefficients (intercept first) of a ridge logistic regression, by Newton steps, each one sum over all rows."""
    names = ["1D", *x]
    coef = np.zeros(len(names))
    penalty = np.full(len(names), ridge)
    penalty[0] = 1e-3
    pairs = list(itertools.combinations_with_replacement(range(len(names)), 2))
    for _ in range(50):
        z = " + ".join(f"{c!r}D * {n}" for c, n in zip(coef.tolist(), names, strict=True))
        p = rows.withColumn("_p", F.expr(f"1 / (1 + exp(-greatest(-30D, least(30D, {z}))))"))
        sums = p.agg(*[F.expr(f"sum({weight} * (_p - {y}) * {n})") for n in names], *[F.expr(f"sum({weight} * _p * (1 - _p) * {names[i]} * {names[j]})") for i, j in pairs]).first()
        g = np.array(sums[: len(names)]) + penalty * coef
        h = np.diag(penalty)
        for (i, j), v in zip(pairs, sums[len(names) :], strict=True):
            h[i, j] += v
            h[j, i] += v * (i != j)
        step = np.linalg.solve(h, g)
        coef -= step
        if np.abs(step).max() < 1e-8:
            break
    return coef.round(9)  # sums of parts in any order


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", support: int = 3) -> Model:
    """The model: characters counted over all documents, evidence from labelled rows.

    All labelled rows whose crc32(key as text) mod 4 is not 2 are fitted on.
    Three quarters of them give the evidence: for each word and beginning of a
    word, the log odds of its distinct contexts (the word before it) among toxic
    and other texts, less a few standard errors; contexts keep copies of one text
    from counting twice.  The last quarter gives the regression.  Without labels of both kinds every text
    scores the share of toxic labels.
    """
    spark = docs.sparkSession
    kept = docs.select(F.col(key).alias("id"), F.col(text).alias("t"))

    def chars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE**3, "i8")
        for b in batches:
            total += char_counts(b.column("t"))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype("i4")), pa.array(total[used])], names=["c", "n"])

    got = kept.select("t").mapInArrow(tidy(chars), "c int, n long").groupBy("c").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SIZE**3)
    counts[got.column("c").to_numpy()] = got.column("n").to_numpy()
    model = Model(char_model(counts))

    rows = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & (crc_mod(F.col(key), 4) != 2)).groupBy(F.col(key).alias("id")).agg(F.max(label).cast("int").alias("y"))
    share = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not share.get(0) or not share.get(1):
        model.coef = np.array([8.0 if share.get(1) else -8.0, 0, 0, 0])
        return model
    fold = F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(4)) == 0
    part = F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(PARTS)) == 0
    # Written once: the texts of labelled rows are read more than once.
    chosen = rows.withColumn("fold", fold).withColumn("part", part)
    chosen = F.broadcast(chosen) if share[0] + share[1] <= KEYS else chosen.hint("shuffle_merge")
    picked = durable(kept.where(crc_mod(F.col("id"), 4) != 2).join(chosen, "id").select("t", "y", "fold", "part"), "labelled")

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = Counter(w for t in b.column("t").to_pylist() for w in LETTER_RUN.findall((t or "").lower()))
            yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], names=["w", "n"])

    counted = picked.select("t").mapInArrow(tidy(frequent), "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).where(F.col("n") >= support)
    model.gain = gains({r["w"]: r["n"] for r in counted.orderBy(F.desc("n"), "w").limit(WORDS).collect()}, model.logp)
    sent, number = spark.sparkContext.broadcast(model), uuid.uuid4().hex

    def clues(sent: Broadcast, number: str, evident: bool) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            r = restorer(sent.value, number)
            seen: set[tuple[int, str, str]] = set()

            def emit() -> pa.RecordBatch:
                columns = zip(*seen, strict=True) if seen else ((), (), ())
                out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.string()), strict=True)], names=["y", "before", "w"])
                seen.clear()
                return out

            for b in batches:
                for t, y in zip(b.column("t").to_pylist(), b.column("y").to_pylist(), strict=True):
                    if evident and not r.features(t or "")[0]:
                        continue
                    words = r.words(t or "")
                    pairs = zip(itertools.repeat(y), ["", *words], words)
                    seen.update((p for p in pairs if r.weight(p[2])) if evident else pairs)
                    if len(seen) >= PAIRS:
                        yield emit()
            yield emit()

        return tidy(run)

    def contexts(rows: DataFrame, sent: Broadcast, number: str, evident: bool = False) -> DataFrame:
        """(f, y, c): evidence, label and context.  Distinct words after each other are far fewer than these, so they are told apart first."""
        pairs = rows.select("t", "y").mapInArrow(clues(sent, number, evident), "y int, before string, w string").distinct()
        evidence = F.explode(F.array(F.concat(F.lit("="), "w"), *[F.when(F.length("w") >= n, F.left("w", F.lit(n))) for n in PREFIXES]))
        return pairs.select("y", F.xxhash64("before").alias("c"), evidence.alias("f")).where("f IS NOT NULL").distinct()

    sizes = {r["y"]: r["n"] for r in picked.where("NOT fold").groupBy("y").agg(F.sum(F.length("t")).alias("n")).collect()}
    n1, n0 = ((sizes.get(y) or 0) + 1 for y in (1, 0))

    def likely(counted: DataFrame) -> dict[str, float]:
        """What is evidence by its numbers of contexts n and m; only that comes to the driver."""
        n, m = F.col("n") + 0.5, F.col("m") + 0.5
        odds = F.log(n / m * F.lit(n0 / n1)) - F.lit(ERRORS) * F.sqrt(1 / n + 1 / m)
        return {r["f"]: r["odds"] for r in counted.select("f", F.round(odds, 4).alias("odds")).where(F.col("odds") > LEAST).collect()}

    # Odds fall with every context among other texts.  What is no evidence by the contexts in a part of these is none by all of them,
    # so the rest is read only for what still may be, and all of it is counted.
    begun = contexts(picked.where("NOT fold AND (y = 1 OR part)"), sent, number).groupBy("f").agg(F.count_if(F.col("y") == 1).alias("n"), F.count_if(F.col("y") == 0).alias("m")).where(F.col("n") >= support)
    begun = durable(begun, "contexts")
    model.evidence = likely(begun)
    if model.evidence:
        may_be = spark.createDataFrame([(f,) for f in model.evidence], "f string")
        others = contexts(picked.where("NOT fold AND y = 0"), spark.sparkContext.broadcast(model), uuid.uuid4().hex, evident=True).groupBy("f").agg(F.count(F.lit(1)).alias("m"))
        model.evidence = likely(begun.join(F.broadcast(may_be), "f").select("f", "n").join(others, "f", "left").select("f", "n", F.coalesce("m", F.lit(0)).alias("m")))
    forget(begun)
    weighed, number_of_evidence = spark.sparkContext.broadcast(model), uuid.uuid4().hex

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = restorer(weighed.value, number_of_evidence)
        for b in batches:
            x = [r.features(t or "") for t in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("y"), *[pa.array([v[k] for v in x], pa.float64()) for k in range(3)]], names=["y", "a", "b", "c"])

    measured = picked.where("fold").select("t", "y").mapInArrow(tidy(measure), "y int, a double, b double, c double")
    # Most texts have no evidence, so equal rows are one with a number.
    features = durable(measured.groupBy("y", "a", "b", "c").agg(F.count(F.lit(1)).alias("n")), "features")
    seen = {r["y"]: r["n"] for r in features.groupBy("y").agg(F.sum("n").alias("n")).collect()}
    if len(seen) == 2:
        # Each label weighs its share of all labels.
        weight = F.col("n") * F.when(F.col("y") == 1, share[1] / seen[1]).otherwise(share[0] / seen[0]) * (sum(seen.values()) / (share[0] + share[1]))
        model.coef = logistic(features.withColumn("weight", weight), ["a", "b", "c"], "y", "weight")
    else:
        model.coef = np.array([-3.0, 0.8, 0.5, 0.5])
    forget(features)
    forget(picked)
    return model


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """All columns of ``docs`` and ``out``, from 0 to 1, of each whole text.

    Only the text is an input.  A null text counts as empty and scores what a
    text without evidence does.  Rows are independent of each other.  A column
    of the name ``out`` is replaced.
    """
    kept = docs.drop(out)
    names = kept.columns
    sent, number = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = restorer(sent.value, number)
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(r.score(part.column(text).to_pylist()))], names=[*names, out])

    return kept.mapInArrow(tidy(run), kept.withColumn(out, F.lit(0.0)).schema)
