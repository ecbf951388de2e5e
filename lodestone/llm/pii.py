"""Personal data and secrets by a skip-chain conditional random field.

Tokens stand between white space, commas, semicolons, quotes and brackets.
Labels are tied along the chain of neighbours, and along skip edges between a
token and the next one in the document that is equal or alike to it: numbers,
addresses of one domain, and words that are a name somewhere in the document.
Sum-product messages are passed over both kinds of edges until they settle, and
each token takes its most likely label.

A plain word, one without any other feature, has the same potential wherever it
stands. Through a long stretch of plain words the chain's message tends to a
fixed point that doesn't depend on what lies before; so messages are passed on
the tokens near one that isn't plain, and the fixed point enters where a stretch
was left out. The tests compare that with the whole chain. No text is cut.

The weights are fitted by pseudo-likelihood on sentences made here, seeded.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELS = ("O", "EMAIL", "PHONE", "IP", "CARD", "ID", "SECRET", "NAME", "ADDRESS")
#: Labels whose neighbouring tokens are one span.
JOINED = {"PHONE", "CARD", "NAME", "ADDRESS"}
#: Plain tokens kept on each side of one that isn't, and most rounds of messages.
REACH, ROUNDS = 6, 16

_TOKEN = re.compile(r"[^\s,;\"<>\[\]{}|]+")
_EDGES = re.compile(r"^[^\w+(]+|[^\w)]+$")
_IP4 = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}"
_IP6 = r"(?=[0-9a-fA-F:]*::|(?:[0-9a-fA-F]+:){7})[0-9a-fA-F]{0,4}(?::[0-9a-fA-F]{0,4}){2,8}"
_SHAPES = {
    "email": re.compile(r"(?:mailto:)?[\w.+-]+@[\w-]+(?:\.[\w-]+)+"),
    "at": re.compile(r".*@.*"),
    "ip": re.compile(rf"{_IP4}(?::\d{{1,5}}|/\d{{1,2}})?"),
    "ip6": re.compile(_IP6),
    "quad": re.compile(r"\d+(?:\.\d+){3}"),
    "card": re.compile(r"\d{13,19}|\d{4}(?:-\d{4}){3}"),
    "four": re.compile(r"\d{4}"),
    "country": re.compile(r"(?:\+|00)\d{1,3}"),
    "area": re.compile(r"\(\d{2,5}\)"),
    "zero": re.compile(r"0\d{2,}(?:[-/.]\d+)*"),
    "local": re.compile(r"\d{2,4}(?:[-.]\d{2,4})+"),
    "ssn": re.compile(r"\d{3}-\d{2}-\d{4}"),
    "iban": re.compile(r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}"),
    "phone": re.compile(r"(?:\+?\d{1,3}[-.]?)?\(?\d{3}\)?[-.]\d{3}[-.]\d{4}|\+\d{8,15}"),
    "hex": re.compile(r"(?=.*\d)[0-9a-fA-F]{20,}"),
    "mixed": re.compile(r"(?=.*\d)(?=.*[A-Za-z])[\w\-+/=]{16,}"),
    "key": re.compile(r"(?:sk|pk|ghp|api|AKIA)[-_]?[A-Za-z0-9_\-]{12,}"),
    "assigned": re.compile(r"(?i)[\"']?(?:token|key|secret|password|passwd|api_key)[\"']?[=:].*\d.*"),
    "letters and digits": re.compile(r"(?=.*\d)(?=.*[A-Za-z])\w{5,15}"),
    "camel": re.compile(r"(?:[A-Z][a-z]+){2,}"),
    "short": re.compile(r"\d{1,3}[a-z]?"),
    "year": re.compile(r"(?:19|20)\d\d"),
    "decimal": re.compile(r"[$€£]?\d+(?:[.,]\d+)+%?"),
    "number": re.compile(r"\d{5,12}"),
    "word": re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*"),
}
_CUES = {
    "mail": "email mail e-mail mailto contact",
    "call": "phone tel telephone call mobile fax ring",
    "host": "ip host server address from",
    "pay": "card visa mastercard credit account paid",
    "identity": "ssn iban passport social",
    "secret": "token key secret password passwd api apikey =",
    "count": "version v page chapter section year in of license under",
}
_CUE = {w: c for c, ws in _CUES.items() for w in ws.split()}
_TITLES = set("Mr Mrs Ms Miss Dr Prof Herr Frau Señor Señora Sra Doña Monsieur Madame Mme Mlle".split())
_STREETS = set("street road avenue lane drive boulevard square straße strasse platz allee rue calle avenida plaza".split())
_STREET = re.compile(r"(?i).+(?:straße|strasse|gasse|platz|allee)")
#: A capitalised word so many tokens after a title, or before or after a street word, may belong to it.
NAME_REACH, STREET_REACH = 3, 3
FEATURES = ("bias", *_SHAPES, "other", "luhn", "no luhn", "run of fours", "after title", "capital", "street", "by street", *(f"{side} {c}" for side in ("after", "before") for c in _CUES))
_AT = {f: k for k, f in enumerate(FEATURES)}
_PLAIN = [0, _AT["word"]]


class Shapes(dict):
    """token -> (core, features by its shape, role), for a bounded number of tokens. Roles: plain word, capitalised word, title, street word, other."""

    LIMIT = 200_000
    PLAIN, CAPITAL, TITLE, STREET, OTHER = range(5)

    def __missing__(self, token: str) -> tuple[str, list[int], int]:
        own = token.strip(".,:!?'…")
        if own.isalpha() and (own.islower() or own[1:].islower()) and not own.startswith(("sk", "pk", "ghp", "api")):
            out = _PLAIN  # what the expressions would give, sooner
        else:
            own = core(token)
            out = [0] + [_AT[s] for s, r in _SHAPES.items() if r.fullmatch(own)]
        if len(out) == 1:
            out.append(_AT["other"])
        if _AT["card"] in out:
            out.append(_AT["luhn" if luhn(own) else "no luhn"])
        role = self.OTHER
        if out == _PLAIN:
            role = self.TITLE if own in _TITLES else self.STREET if own.lower() in _STREETS or _STREET.fullmatch(own) else self.CAPITAL if own[0].isupper() and len(own) > 1 else self.PLAIN
        if len(self) < self.LIMIT:
            self[token] = own, out, role
        return own, out, role


def core(token: str) -> str:
    """The token without punctuation around it."""
    return _EDGES.sub("", token)


def luhn(digits: str) -> bool:
    d = [int(c) for c in digits if c.isdigit()][::-1]
    return (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def alike(own: str) -> str | None:
    """Tokens with the same key are linked: equal ones, addresses of one domain, and numbers that differ in punctuation only."""
    if "@" in own:
        return "@" + own.lower().rpartition("@")[2]
    digits = re.sub(r"\D", "", own)
    if len(digits) >= 6 and len(digits) >= 0.6 * len(own):
        return "#" + digits
    return own.lower() if digits and len(own) >= 4 else None


def observed(known: list[tuple[str, list[int], int]]) -> tuple[list[list[int]], set[str]]:
    """Features of each token by position in FEATURES, and the words that are a name after a title somewhere."""
    seen = [f for _, f, _ in known]
    n = len(known)
    titled: set[int] = set()
    special = [i for i, (_, _, role) in enumerate(known) if role >= Shapes.TITLE]
    for i in special:
        role = known[i][2]
        if role == Shapes.TITLE:
            for j in range(i + 1, min(n, i + 1 + NAME_REACH)):
                if known[j][2] != Shapes.CAPITAL:
                    break
                titled.add(j)
        elif role == Shapes.STREET:
            around = []
            for way in (range(i - 1, max(-1, i - STREET_REACH - 1), -1), range(i + 1, min(n, i + STREET_REACH + 1))):
                for j in way:
                    if known[j][2] != Shapes.CAPITAL and _AT["short"] not in known[j][1]:
                        break
                    around.append(j)
            if any(_AT["short"] in known[j][1] for j in around):
                seen[i] = [*seen[i], _AT["street"]]
                for j in around:
                    seen[j] = [*seen[j], _AT["by street"]]
        else:
            more = []
            if _AT["four"] in known[i][1]:
                a = b = i
                while a > 0 and _AT["four"] in known[a - 1][1]:
                    a -= 1
                while b + 1 < n and _AT["four"] in known[b + 1][1]:
                    b += 1
                if b - a == 3:
                    more.append(_AT["run of fours"])
            for side, near in (("after", range(i - 1, max(-1, i - 4), -1)), ("before", range(i + 1, min(n, i + 2)))):
                found = {_CUE[w] for j in near if (w := known[j][0].lower()) in _CUE}
                more += [_AT[f"{side} {c}"] for c in sorted(found)]
            if i and known[i - 1][0] == "":
                more += [_AT["after secret"]] if _AT["after secret"] not in more and known[i - 1][2] == Shapes.OTHER and i > 1 and known[i - 2][0].lower() in _CUES["secret"].split() else []
            seen[i] = [*seen[i], *more]
    names = {known[j][0] for j in titled}
    if names:
        for j, (own, _, role) in enumerate(known):
            if role == Shapes.CAPITAL and own in names:
                seen[j] = [*seen[j], _AT["capital"], *([_AT["after title"]] if j in titled else [])]
    return seen, names


class Graph:
    """Nodes, features and edges of one or several documents."""

    def __init__(self) -> None:
        self.where: list[tuple[int, int, int]] = []
        self.seen: list[list[int]] = []
        self.chain: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int]] = []
        self.opens: list[int] = []
        self.closes: list[int] = []

    def add(self, text: str, doc: int, shapes: Shapes, whole: bool = False) -> None:
        """A document's tokens near one that isn't plain, or all of them."""
        known = list(map(shapes.__getitem__, _TOKEN.findall(text)))
        if not whole and all(role < Shapes.TITLE for _, _, role in known):
            return
        found = list(_TOKEN.finditer(text))
        seen, names = observed(known)
        near: set[int] = set()
        if whole:
            near.update(range(len(known)))
        else:
            for i, f in enumerate(seen):
                if f != _PLAIN:
                    near.update(range(max(0, i - REACH), min(len(known), i + REACH + 1)))
        last, linked = None, {}
        for i in sorted(near):
            node = len(self.where)
            self.where.append((doc, *found[i].span()))
            self.seen.append(seen[i])
            if last is not None and last == i - 1:
                self.chain.append((node - 1, node))
            else:
                if last is not None:
                    self.closes.append(node - 1)
                if i > 0:
                    self.opens.append(node)
            own = known[i][0]
            key = "=" + own if own in names else alike(own) if known[i][2] == Shapes.OTHER else None
            if key is not None:
                if key in linked:
                    self.skip.append((linked[key], node))
                linked[key] = node
            last = i
        if last is not None and last + 1 < len(known):
            self.closes.append(len(self.where) - 1)


def _flat(seen: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(seen)), [len(s) for s in seen]), np.array([f for s in seen for f in s], int)


class Model:
    """Potentials: features x labels, labels x labels along the chain and along skip edges."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.unary, self.chain, self.skip = unary, np.exp(chain), np.exp(skip)
        plain = np.exp(unary[_AT["bias"]] + unary[_AT["word"]])
        self.into, self.back = self._settled(plain, self.chain), self._settled(plain, self.chain.T)

    @staticmethod
    def _settled(plain: np.ndarray, step: np.ndarray) -> np.ndarray:
        m = np.full(len(plain), 1 / len(plain))
        for _ in range(200):
            m = (m * plain) @ step
            m /= m.sum()
        return m

    def marginals(self, g: Graph) -> np.ndarray:
        n = len(g.where)
        row, col = _flat(g.seen)
        own = np.zeros((n, len(LABELS)))
        np.add.at(own, row, self.unary[col])
        own[g.opens] += np.log(self.into)
        own[g.closes] += np.log(self.back)
        pairs = np.array(g.chain + g.skip, int).reshape(-1, 2)
        kind = np.r_[np.zeros(len(g.chain), int), np.ones(len(g.skip), int)]
        a, b = pairs[:, 0], pairs[:, 1]
        source, target = np.r_[a, b], np.r_[b, a]
        other = np.r_[np.arange(len(a)) + len(a), np.arange(len(a))]
        sort = [np.nonzero(np.r_[kind, kind + 2] == k)[0] for k in range(4)]
        steps = (self.chain, self.skip, self.chain.T, self.skip.T)
        sent = np.zeros((len(source), len(LABELS)))
        for _ in range(ROUNDS):
            total = own.copy()
            for which in sort:  # of each kind a node gets one message at most
                total[target[which]] += sent[which]
            before = total[source] - sent[other]
            before = np.exp(before - before.max(axis=1, keepdims=True)) if len(before) else before
            new = np.empty_like(sent)
            for which, step in zip(sort, steps):
                new[which] = before[which] @ step
            new = np.log(new / new.sum(axis=1, keepdims=True)) if len(new) else new
            change = np.abs(new - sent).max() if len(new) else 0.0
            sent = 0.5 * sent + 0.5 * new if len(g.skip) else new
            if change < 1e-4:
                break
        total = own
        for which in sort:
            total[target[which]] += sent[which]
        total = np.exp(total - total.max(axis=1, keepdims=True)) if n else total
        return total / total.sum(axis=1, keepdims=True) if n else total


def made_sentences(number: int, seed: int) -> list[tuple[list[str], list[str]]]:
    """Tokens and labels of invented sentences with private data and look-alikes."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bcdfghklmnprstvw") + rng.choice("aeiouéöñ") + rng.choice("nrstl") for _ in range(rng.randrange(1, 4)))
    d = lambda k: "".join(rng.choices("0123456789", k=k))
    pick = lambda *x: rng.choice(x)
    hexes = lambda k: "".join(rng.choices("0123456789abcdef", k=k))
    alnum = lambda k: "".join(rng.choices("abcdefghijkmnopqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789", k=k))

    name = lambda: word().capitalize()

    def entity() -> list[tuple[str, str]]:
        k = rng.randrange(13)
        if k == 9:
            return pick([("123-45-6789".translate(str.maketrans("123456789", d(9))), "ID")], [(pick("DE", "FR", "GB") + d(20), "ID")])
        if k == 10:
            return [(name(), "NAME") for _ in range(rng.randrange(1, 3))]
        if k == 11:
            number, street = (d(rng.randrange(1, 4)), "ADDRESS"), [(name(), "ADDRESS"), (pick("Street", "Road", "Avenue", "Lane"), "ADDRESS")]
            return pick([number, *street], [(name() + "straße", "ADDRESS"), number], [number, (pick("rue", "Calle"), "ADDRESS"), (name(), "ADDRESS")], [(pick("Calle", "Plaza"), "ADDRESS"), (name(), "ADDRESS"), number])
        if k == 12:
            return pick([(x, "CARD") for x in (d(4), d(4), d(4), d(4))], [(":".join(hexes(4) for _ in range(8)), "IP")], [(f"{hexes(4)}:{hexes(3)}::{hexes(2)}", "IP")], [(".".join(str(rng.randrange(1, 255)) for _ in range(4)) + ":" + d(4), "IP")])
        if k <= 1:
            return [(pick(word() + "." + d(2), word(), word() + "_" + word()) + "@" + word() + pick("", d(1)) + pick(".com", ".org", ".example.com"), "EMAIL")]
        if k <= 3:
            tail = [(f"({d(3)})", "PHONE"), (f"{d(3)}-{d(4)}", "PHONE")]
            spaced = [(x, "PHONE") for x in (d(3), d(rng.randrange(5, 9)))]
            if rng.random() < 0.4:
                return pick([("+" + d(2), "PHONE"), *spaced], [(pick("phone", "call", "tel"), "O"), ("0" + d(3), "PHONE"), (d(rng.randrange(5, 9)), "PHONE")], [("0" + d(3), "PHONE"), (d(8), "PHONE")])
            return pick([("+" + d(1), "PHONE"), *tail], tail, [(f"{d(3)}-{d(3)}-{d(4)}", "PHONE")], [(f"+{d(11)}", "PHONE")])
        if k == 4 or k == 5:
            return [(".".join(str(rng.randrange(1, 255)) for _ in range(4)), "IP")]
        if k == 6:
            return pick([(d(16), "CARD")], [(d(16), "CARD")], [(x, "CARD") for x in ("-".join([d(4), d(4), d(4), d(4)]),)])
        secret = pick(hexes(40), hexes(32), alnum(24), "sk-" + alnum(20), "ghp_" + alnum(24))
        if not any(c.isdigit() for c in secret):
            secret += "7"
        weak = pick(word() + d(rng.randrange(1, 4)), alnum(8) + d(1), "".join(name() for _ in range(3)))
        if rng.random() < 0.4:
            return [(pick("password", "Password:", "password:", "secret", "passwd", "key:"), "O"), *pick([], [("=", "O")]), (weak, "SECRET")]
        return pick([(secret, "SECRET")], [(pick("token", "password", "key"), "O"), ("=", "O"), (f'"{secret}"', "SECRET")], [(f"{pick('token', 'key', 'secret')}={secret}", "SECRET")])

    def lure() -> list[tuple[str, str]]:
        return pick(
            [("version", "O"), (f"{d(1)}.{d(1)}.", "O")],
            [(str(rng.randrange(1900, 2030)), "O")],
            [(d(rng.randrange(1, 4)), "O")],
            [(f"{d(3)},{d(3)}", "O")],
            [("page", "O"), (d(2), "O")],
            [("$" + d(2) + "." + d(2), "O")],
            [(d(rng.randrange(5, 9)), "O")],
            [(f"{d(1)}.{d(2)}.{d(1)}", "O")],
            [(word() + d(2), "O")],
            [(f"{d(4)}-{d(2)}-{d(2)}", "O")],
            [("@" + word(), "O")],
            [(f"v{d(1)}.{d(1)}", "O")],
            [(name(), "O")],
            [(name() + name(), "O")],
            [(pick("password", "key", "secret", "token"), "O"), (word(), "O")],
            [(d(1) + ":" + d(2) + ":" + d(2), "O")],
            [(pick("street", "road"), "O"), (word(), "O")],
            [(d(4), "O"), (d(4), "O")],
        )

    out = []
    for _ in range(number):
        rows: list[tuple[str, str]] = []
        known, named = [entity() for _ in range(rng.randrange(1, 3))], set()
        for _ in range(rng.randrange(2, 6)):
            rows += [(word() + pick("", "", "", ".", ","), "O") for _ in range(rng.randrange(1, 6))]
            k = rng.random()
            new = pick(*known) if k < 0.45 else lure() if k < 0.9 else []
            if new and new[0][1] == "NAME" and (new[0][0] not in named or rng.random() < 0.5):
                rows.append((pick("Mr", "Mrs.", "Dr.", "Herr", "Frau", "Madame"), "O"))
                named.update(x for x, _ in new)
            rows += new
            if rng.random() < 0.15 and rows[-1][1] != "O":
                rows[-1] = (rows[-1][0] + pick(".", ",", "!!", "###", "***"), rows[-1][1])
        out.append(([t for t, _ in rows], [y for _, y in rows]))
    return out


def fit(sentences: list[tuple[list[str], list[str]]], l2: float = 0.02, steps: int = 250) -> Model:
    """Weights that make each label likely given its neighbours' and linked tokens' labels."""
    g, labels, shapes = Graph(), [], Shapes()
    index = {y: k for k, y in enumerate(LABELS)}
    for doc, (tokens, ys) in enumerate(sentences):
        at = len(g.where)
        text = " ".join(tokens)
        g.add(text, doc, shapes, True)
        starts = np.cumsum([0] + [len(t) + 1 for t in tokens])[:-1]
        labels += [index[ys[np.searchsorted(starts, a, "right") - 1]] for _, a, _ in g.where[at:]]
    y = np.array(labels)
    n, size = len(y), len(LABELS)
    kinds: dict[tuple[int, ...], int] = {}
    kind = np.array([kinds.setdefault(tuple(f), len(kinds)) for f in g.seen])  # tokens with the same features
    x = np.zeros((len(kinds), len(FEATURES)))
    for f, k in kinds.items():
        x[k, list(f)] = 1
    pairs = (np.array(g.chain, int).reshape(-1, 2), np.array(g.skip, int).reshape(-1, 2))
    theta = [np.zeros((len(FEATURES), size)), np.zeros((size, size)), np.zeros((size, size))]
    m, v = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    one = np.eye(size)
    for t in range(1, steps + 1):
        z = (x @ theta[0])[kind]
        for k, p in enumerate(pairs, 1):
            z[p[:, 1]] += theta[k][y[p[:, 0]]]  # a node has one neighbour of each kind on each side at most
            z[p[:, 0]] += theta[k].T[y[p[:, 1]]]
        prob = np.exp(z - z.max(axis=1, keepdims=True))
        err = prob / prob.sum(axis=1, keepdims=True) - one[y]
        grads = [np.zeros_like(t_) for t_ in theta]
        grads[0] = x.T @ np.stack([np.bincount(kind, e, len(kinds)) for e in err.T], axis=1)
        for k, p in enumerate(pairs, 1):
            grads[k] = one[y[p[:, 0]]].T @ err[p[:, 1]] + (one[y[p[:, 1]]].T @ err[p[:, 0]]).T
        for k in range(3):
            grad = grads[k] + l2 * theta[k] * (1 if k == 0 else 5)
            m[k], v[k] = 0.9 * m[k] + 0.1 * grad, 0.99 * v[k] + 0.01 * grad * grad
            theta[k] = theta[k] - 0.1 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
    return Model(*theta)


@lru_cache(maxsize=4)
def trained(sentences: int = 3000, seed: int = 3) -> Model:
    return fit(made_sentences(sentences, seed))


_INNER = {"EMAIL": re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"), "SECRET": re.compile(r"(?:(?:sk|pk|ghp|api)[-_])?[A-Za-z0-9+/_\-]{12,}"), "IP": re.compile(rf"(?<![\d.]){_IP4}(?![\d.])|{_IP6}")}
_ASSIGNED = re.compile(r"(?i)^[\"']?(?:token|key|secret|password|passwd|api_key)[\"']?[=:][\"']?")


def spans_of(g: Graph, best: np.ndarray, texts: list[str]) -> list[tuple[int, int, int, str]]:
    """(doc, start, end, label): neighbouring tokens of some labels are one span; punctuation around is left out; each address in a token is a span."""
    merged: list[list] = []
    follows = {b: a for a, b in g.chain}
    for node in np.nonzero(best)[0].tolist():
        doc, a, b = g.where[node]
        label, before = LABELS[best[node]], follows.get(node)
        joins = label in JOINED and (label != "CARD" or b - a <= 5)  # groups of a card's digits, not whole numbers
        if joins and merged and before is not None and merged[-1][4] == before and merged[-1][3] == label and not texts[doc][merged[-1][1] : a].rstrip().endswith((".", ",", ";")):
            merged[-1][2], merged[-1][4] = b, node
        else:
            merged.append([doc, a, b, label, node])
    out = []
    for doc, a, b, label, _ in merged:
        s = texts[doc][a:b]
        if label == "SECRET":
            cut = _ASSIGNED.match(s)
            at = cut.end() if cut else 0
            inner = _INNER[label].findall(s[at:])
            want = max(inner, key=len) if inner else core(s[at:])
            found = [(s.rfind(want), want)]
        elif label in _INNER and _INNER[label].search(s):
            found = [(m.start(), m[0]) for m in _INNER[label].finditer(s)]
        else:
            found = [(s.find(core(s)), core(s))]
        out += [(doc, a + at, a + at + len(want), label) for at, want in found if want]
    return out


def find(texts: list[str | None], model: Model, shapes: Shapes | None = None, whole: bool = False) -> list[tuple[int, int, int, str]]:
    """(text, start, end, label) of all private data in the texts; whole: without leaving plain stretches out."""
    g, shapes = Graph(), Shapes() if shapes is None else shapes
    full = [t or "" for t in texts]
    for k, t in enumerate(full):
        g.add(t, k, shapes, whole)
    return spans_of(g, model.marginals(g).argmax(axis=1), full) if g.where else []


def private_data(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, start, end, label, value), start and end in characters of the text.

    Labels are EMAIL, PHONE, IP, CARD, ID (social security and bank account
    numbers), SECRET, NAME (after a title, and again wherever it repeats) and
    ADDRESS (house number and street). A null or empty text has none. Every row is scanned, so rows that repeat
    give their spans again; a null doc_id is kept. Extra columns are ignored;
    an empty table gives an empty result. value is the text of the span.
    """
    model = model or trained()
    own = docs.select("doc_id", "text").filter(F.col("text").isNotNull())
    kind = own.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows = [(k + d, *r) for k in range(0, len(texts), 500) for d, *r in find(texts[k : k + 500], model, shapes)]
            doc, a, b, label = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc, pa.int32())), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(label, pa.string()), pa.array([texts[d][x:y] for d, x, y, _ in rows], pa.string())],
                ["doc_id", "start", "end", "label", "value"],
            )

    return own.mapInArrow(run, f"doc_id {kind}, start int, end int, label string, value string")
