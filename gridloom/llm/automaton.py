"""A combined deterministic automaton for many byte rules: parse, Thompson construction, subset construction, minimisation, and a scan in one byte pass.

The rules' syntax: literals, escapes \\xHH \\. and the like, classes [..] with ranges, groups (..), |, and the repetitions ? * + {n} {n,} {n,m}.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

Node = tuple
#: Rules of one automaton: a scan holds a bit for each in a byte.
MOST_RULES = 8


def parse(rule: str) -> Node:
    """The rule's syntax tree: ('set', bits) | ('cat', [..]) | ('alt', [..]) | ('rep', node, least, most or None)."""
    at = 0

    def peek() -> str:
        return rule[at] if at < len(rule) else ""

    def take() -> str:
        nonlocal at
        at += 1
        return rule[at - 1]

    def char() -> int:
        c = take()
        if c != "\\":
            return ord(c)
        c = take()
        if c == "x":
            return int(take() + take(), 16)
        return {"n": 10, "t": 9, "r": 13}.get(c, ord(c))

    def klass() -> int:
        bits = 0
        negated = peek() == "^" and bool(take())
        while peek() != "]":
            lo = char()
            hi = lo
            if peek() == "-" and rule[at + 1] != "]":
                take()
                hi = char()
            bits |= ((1 << (hi + 1)) - 1) & ~((1 << lo) - 1)
        take()
        return ((1 << 256) - 1) & ~bits if negated else bits

    def atom() -> Node:
        c = peek()
        if c == "(":
            take()
            node = alternatives()
            take()
        elif c == "[":
            take()
            node = ("set", klass())
        else:
            node = ("set", 1 << char())
        while peek() and peek() in "?*+{":
            c = take()
            least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(c, (0, 0))
            if c == "{":
                end = rule.index("}", at)
                lo, comma, hi = rule[at:end].partition(",")
                least, most = int(lo), int(hi) if hi else None if comma else int(lo)
                at_end(end + 1)
            node = ("rep", node, least, most)
        return node

    def at_end(to: int) -> None:
        nonlocal at
        at = to

    def alternatives() -> Node:
        branches = [[]]
        while peek() and peek() != ")":
            if peek() == "|":
                take()
                branches.append([])
            else:
                branches[-1].append(atom())
        return ("alt", [("cat", b) for b in branches])

    return alternatives()


@dataclass
class Automaton:
    """step[state * classes + class of byte]: the next state; accepts[state]: bit k if rule k has a match that ends here. State 0 is the start."""

    step: np.ndarray
    klass: np.ndarray
    classes: int
    accepts: np.ndarray
    #: Bytes after which every state is the start: a text can be cut there.
    resets: np.ndarray

    @property
    def states(self) -> int:
        return len(self.accepts)


def reversed_tree(node: Node) -> Node:
    """The tree of the rule read backwards."""
    if node[0] == "cat":
        return ("cat", [reversed_tree(part) for part in node[1][::-1]])
    if node[0] == "alt":
        return ("alt", [reversed_tree(part) for part in node[1]])
    return node if node[0] == "set" else ("rep", reversed_tree(node[1]), *node[2:])


def compile_rules(rules: list[str], ceiling: int = 60_000, backwards: bool = False, anchored: bool = False) -> Automaton:
    """The minimal automaton that reports, at each byte, which rules have a match that ends there. anchored: that begins at the first byte.

    backwards: the rules read backwards, anchored: it reports where a match that ends at the first byte begins.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"a scan reports at most {MOST_RULES} rules")
    anchored = anchored or backwards
    moves: list[list[tuple[int, int]]] = []
    empty: list[list[int]] = []

    def state() -> int:
        moves.append([])
        empty.append([])
        return len(moves) - 1

    def build(node: Node, start: int) -> int:
        kind = node[0]
        if kind == "set":
            end = state()
            moves[start].append((node[1], end))
            return end
        if kind == "cat":
            for part in node[1]:
                start = build(part, start)
            return start
        if kind == "alt":
            end = state()
            for part in node[1]:
                s = state()
                empty[start].append(s)
                empty[build(part, s)].append(end)
            return end
        _, inner, least, most = node
        for _ in range(least):
            start = build(inner, start)
        if most is None:
            loop = state()
            empty[start].append(loop)
            empty[build(inner, loop)].append(loop)
            return loop
        end = state()
        empty[start].append(end)
        for _ in range(most - least):
            start = build(inner, start)
            empty[start].append(end)
        return end

    final: dict[int, int] = {}
    root = state()
    for k, rule in enumerate(rules):
        s = state()
        empty[root].append(s)
        final[build(reversed_tree(parse(rule)) if backwards else parse(rule), s)] = 1 << k

    # bytes that no set tells apart are one class
    sets = sorted({bits for own in moves for bits, _ in own})
    signature = np.array([[bits >> b & 1 for bits in sets] for b in range(256)], np.uint8)
    _, first, klass = np.unique(signature, axis=0, return_index=True, return_inverse=True)
    klass = klass.reshape(-1).astype(np.uint8)
    sample = [int(b) for b in first]

    def closure(some: set[int]) -> frozenset[int]:
        stack, seen = list(some), set(some)
        while stack:
            for t in empty[stack.pop()]:
                if t not in seen:
                    seen.add(t)
                    stack.append(t)
        return frozenset(s for s in seen if moves[s] or s in final)

    start = closure({root})
    number, queue, table, labels = {start: 0}, [start], [], []
    while queue:
        subset = queue.pop(0)
        labels.append(sum({final[s] for s in subset if s in final}))
        row = []
        for b in sample:
            target = {t for s in subset for bits, t in moves[s] if bits >> b & 1}
            nxt = closure(target) if anchored else closure(target) | start
            if nxt not in number:
                number[nxt] = len(number)
                queue.append(nxt)
                if len(number) > ceiling:
                    raise ValueError(f"the rules need more than {ceiling} states")
            row.append(number[nxt])
        table.append(row)
    step, accepts = np.array(table, np.int64), np.array(labels, np.int64)

    # minimisation: states are one class until what they accept or where they lead differs
    _, block = np.unique(accepts, return_inverse=True)
    while True:
        _, first, finer = np.unique(np.column_stack([block, block[step]]), axis=0, return_index=True, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    order = np.argsort(np.array([(accepts[f] > 0) for f in first]), kind="stable")  # accepting states last, for one comparison a step
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    origin = place[block[0]]
    swap = np.arange(len(order))
    swap[[0, origin]] = origin, 0  # the start accepts nothing, as no rule matches the empty text
    place = swap[place]
    small = np.empty((len(order), step.shape[1]), np.int64)
    marks = np.empty(len(order), np.int64)
    small[place] = place[block[step[first]]]
    marks[place] = accepts[first]
    back = np.flatnonzero((small == 0).all(0))
    return Automaton(small.astype(np.uint16 if len(small) < 65536 else np.uint32).ravel(), klass, small.shape[1], marks, np.isin(klass, back))


@dataclass
class Hits:
    """The bytes of some texts, one after another; edge[i]: where text i begins; found: at each byte, the bits of the rules with a match that ends there."""

    buf: np.ndarray
    edge: np.ndarray
    found: np.ndarray

    def runs(self, rule: int) -> tuple[np.ndarray, np.ndarray]:
        """(first, end) of the longest runs of bytes at which matches of the rule end, none over two texts."""
        at = np.flatnonzero(self.found >> np.uint8(rule) & np.uint8(1)) if self.found.any() else np.zeros(0, np.int64)
        if not len(at):
            return at, at
        new = np.concatenate(([True], (np.diff(at) > 1) | np.isin(at[1:], self.edge)))
        return at[new], np.append(at[:-1][new[1:]], at[-1]) + 1


def _entries(auto: Automaton, klass: np.ndarray, start: np.ndarray, follows: np.ndarray, chunk: int) -> np.ndarray:
    """The states in which pieces begin, where a piece that follows another begins in the state that the other, of `chunk` bytes, ends in.

    All pieces are run abreast, each from every state that its last byte before can lead to; runs that meet go on as one. The states are then
    read off from piece to piece.
    """
    states, entry = auto.states, np.zeros(len(start), np.int64)
    asked = np.flatnonzero(np.append(follows[1:], False))  # whose end is asked for
    if not len(asked):
        return entry
    table = auto.step.reshape(states, auto.classes)
    after = [np.unique(table[:, c]) for c in range(auto.classes)]
    begin = [after[klass[start[i] - 1]] if follows[i] else np.zeros(1, np.int64) for i in asked]
    piece = np.repeat(np.arange(len(asked)), [len(b) for b in begin])
    origin = np.concatenate(begin).astype(np.int64)
    lead = np.arange(len(piece))  # which run each origin is in
    run_piece, state = piece, origin
    for t in range(chunk):
        state = auto.step[state * auto.classes + klass[start[asked][run_piece] + t]].astype(np.int64)
        if t & (t + 1) == 0:
            key, back = np.unique(run_piece * states + state, return_inverse=True)
            lead, run_piece, state = back.reshape(-1)[lead], key // states, key % states
    ends = dict(zip((piece * states + origin).tolist(), state[lead].tolist()))
    place = {int(i): k for k, i in enumerate(asked)}
    for i in np.flatnonzero(follows):
        entry[i] = ends[place[i - 1] * states + int(entry[i - 1])]
    return entry


def scan(auto: Automaton, texts: list[bytes], chunk: int = 1024) -> Hits:
    """Where matches end: one pass over the bytes, many pieces of text abreast.

    A text is cut after bytes that lead every state to the start. Where such bytes are far apart it is cut all the same, and the states at the
    cuts come from _entries. There may be eight rules.
    """
    buf = np.frombuffer(b"".join(texts), np.uint8)
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    edge = np.concatenate(([0], np.cumsum(length)))[:-1]
    found = np.zeros(len(buf), np.uint8)
    if not len(buf):
        return Hits(buf, edge, found)
    klass = auto.klass[buf]
    cuts = [edge]
    after = np.flatnonzero(auto.resets[buf]) + 1
    if len(after):
        near = after[np.minimum(np.searchsorted(after, np.arange(chunk, len(buf), chunk)), len(after) - 1)]
        cuts.append(near)
    start = np.unique(np.concatenate(cuts))
    start = start[start < len(buf)]
    size = np.diff(np.append(start, len(buf)))
    parts = np.where(size > 4 * chunk, size // chunk, 1)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    start = np.repeat(start, parts) + nth * chunk
    size = np.diff(np.append(start, len(buf)))
    state = _entries(auto, klass, start, nth > 0, chunk)
    order = np.argsort(-size, kind="stable")
    start, size, state = start[order], size[order], state[order]
    accepting = int((auto.accepts == 0).sum())
    live = np.searchsorted(-size, -np.arange(int(size[0])), side="left")  # pieces longer than t
    for t in range(int(size[0])):
        k = live[t]
        own = auto.step[state[:k] * auto.classes + klass[start[:k] + t]]
        state[:k] = own
        hit = np.flatnonzero(own >= accepting)
        if len(hit):
            found[start[hit] + t] = auto.accepts[own[hit]]
    return Hits(buf, edge, found)


class Anchored:
    """The ends of a rule's matches that begin at a place, or the beginnings of those that end there, byte by byte."""

    def __init__(self, rule: str, backwards: bool = False) -> None:
        auto = compile_rules([rule], backwards=backwards, anchored=True)
        table = auto.step.reshape(auto.states, auto.classes).astype(np.int64)
        own = np.arange(auto.states)
        dead = np.flatnonzero((table == own[:, None]).all(1) & (auto.accepts == 0))
        self.dead = int(dead[0]) if len(dead) else -1
        self.rows = [row[auto.klass].tolist() for row in table]
        self.accepts = (auto.accepts > 0).tolist()

    def first(self, data: bytes, end: int, floor: int) -> int:
        """The leftmost place, from floor on, where a match that ends at `end` begins; -1 if there is none."""
        state, best = 0, -1
        for p in range(end - 1, floor - 1, -1):
            state = self.rows[state][data[p]]
            if state == self.dead:
                break
            if self.accepts[state]:
                best = p
        return best

    def last(self, data: bytes, start: int, end: int) -> int:
        """The rightmost place, up to `end`, where a match that begins at `start` ends; -1 if there is none."""
        state, best = 0, -1
        for p in range(start, end):
            state = self.rows[state][data[p]]
            if state == self.dead:
                break
            if self.accepts[state]:
                best = p + 1
        return best
