"""Personal data by a skip-chain conditional random field.

The base patterns are always reported. Beside them a random field labels tokens: its nodes are the tokens near a digit, an account mark or a cue word, the tokens of base spans, and every other
token of the document that repeats one of these or is like it (same letters, same last digits). Neighbouring tokens share chain potentials; a repeated or similar token shares a
skip potential with the one before of its kind, however far away, so an occurrence without a cue is told by one that has it. Labels follow from the nodes' beliefs after a fixed
number of rounds of loopy message passing; runs of one label are a span. Spans of the method lie outside the base spans.

The field is trained by composite likelihood on drawn documents: public formats and cue words in four languages among invented words and numbers that are no personal data. No table is
read for that, the number of drawn documents is DRAWN; the model, a few thousand numbers, is fitted once and sent with the tasks. One narrow Python stage, no shuffle.

Each occurrence is linked to the one before only, so links grow with the tokens. Patterns are linear in the text. Graphs of several documents are labelled together, up to about NODES nodes;
documents don't meet in them.

Defined cases: null or empty text: no spans; texts of any length: one at a time; ties: spans of one start are in the order of KINDS; repeated rows and extra columns don't matter; empty table: empty
result. Offsets count code points.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import random
import re
from array import array
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common
from .secrets import in_code_points

BASE_KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", "name", "handle", "written_email", "local_phone", "national_id", "account", "birth_date")
KINDS = (*BASE_KINDS, *LABELS[1:])

#: Parts of the fixed base patterns; on bytes, so that classes are ASCII's alone.
LOCAL, DOMAIN = re.compile(rb"[A-Za-z0-9._%+-]+\Z"), re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_BYTES = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOTTED = re.compile(rb"(?<![0-9])[0-9]++(?:\.[0-9]++)++")
CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(rb"[0-9]")


def luhn(digits: list[int]) -> bool:
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text: bytes) -> list[tuple[int, int, str]]:
    """Byte spans of the base patterns, in time linear in the text."""
    out, end, at = [], 0, text.find(b"@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_BYTES:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        end = found.end() if found else at + 1
        if found:
            out.append((start, end, "email"))
        at = text.find(b"@", end)
    if not DIGITS.search(text):
        return out
    for m in DOTTED.finditer(text):  # a match takes four numbers of a dotted run, the next one goes on behind it
        numbers = [(x.start(), x.end()) for x in re.finditer(rb"[0-9]+", m[0])]
        for four in zip(*(numbers[i::4] for i in range(4)), strict=False):
            if all(len(n := m[0][a:b].lstrip(b"0")) < 4 and int(n or b"0") <= 255 for a, b in four):
                out.append((m.start() + four[0][0], m.start() + four[3][1], "ip"))
    for m in CARD.finditer(text):
        digits = [c - 48 for c in m[0] if c > 47]
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((*m.span(), "card"))
    if b"+" in text:
        out += [(*m.span(), "phone") for m in PHONE.finditer(text) if 9 <= sum(48 <= c <= 57 for c in m[0]) <= 15]
    return out


#: Words that announce personal data, by what they announce. Fixed values.
CUES = {
    "name": "mr mrs ms dr prof dear named signed sincerely attn herr frau herrn monsieur madame mme señor señora sra",
    "phone": "tel phone call mobile fax telephone telefon handy téléphone teléfono móvil",
    "id": "ssn social security",
    "account": "iban konto account compte cuenta",
    "birth": "born birth dob birthday birthdate geboren geburtsdatum née naissance nacido nacida nacimiento",
    "handle": "twitter instagram telegram username handle login",
    "at": "at",
    "dot": "dot",
    "ending": "com org net edu de fr es",
}
CUE = {word: kind for kind, words in CUES.items() for word in words.split()}
#: Cues that tell only near a node, and those that may start a field.
QUIET = ("at", "ending")
STARTING = frozenset(w.encode() for w, kind in CUE.items() if kind not in QUIET)
TOKEN = re.compile(r"@?\w+(?:['._%+/\-]+\w+)*+")
NEAR, ROUNDS, DAMPING, CONFIDENCE, NODES = 4, 20, 0.5, 0.6, 8192
CHAIN, BROKEN, SAME, SIMILAR = range(4)


def key_of(word: str) -> str:
    """Equal for repeated and for similar tokens: the last seven digits of a number, a word's letters without the ending of a genitive or the mark of an account."""
    digits = "".join(c for c in word if c in "0123456789")
    if len(digits) >= 4 and len(digits) * 2 >= len(word):
        return digits[-7:]
    return re.sub(r"['’]s$", "", word.lower()).lstrip("@")


class Token(NamedTuple):
    text: str
    start: int
    end: int
    base: str  # kind of the base span that it lies in, or ""

    @property
    def distinctive(self) -> bool:
        """Whether it may be the same thing wherever it stands: marked by a capital, a digit or an account mark, and no cue."""
        return distinctive(self.text, self.base)


def distinctive(word: str, base: str = "") -> bool:
    marked = word[0].isupper() or word[0] == "@" or any(c.isdigit() for c in word) or base == "email"
    return marked and len(key := key_of(word)) > 2 and key not in CUE


class Tokens:
    """The tokens of a text by their places; each is made when it is asked for, so a long text isn't held as objects."""

    def __init__(self, text: str, base: list[tuple[int, int, str]]) -> None:
        self.text, self.base = text, sorted(base)
        self.spans = np.fromiter((x for m in TOKEN.finditer(text) for x in m.span()), np.int64).reshape(-1, 2)

    def __len__(self) -> int:
        return len(self.spans)

    def __getitem__(self, i: int) -> Token:
        start, end = self.spans[i].tolist()
        at = bisect.bisect_left(self.base, (end,)) - 1
        # A base span may lie inside another one, so some before it may reach further.
        inside = next((k for a, b, k in reversed(self.base[max(0, at - 3) : at + 1]) if b > start), "")
        return Token(self.text[start:end], start, end, inside)

    def words(self) -> Iterator[str]:
        return (m[0] for m in TOKEN.finditer(self.text))

    def nodes(self) -> list[int]:
        """Numbers of the tokens that are nodes of the field."""
        near: set[int] = set()
        of_base = [x for a, b, _ in self.base for x in range(*np.searchsorted(self.spans[:, 1], [a, b], "right").tolist())]
        marks = (i for i, w in enumerate(self.words()) if w[0] == "@" or CUE.get(w.lower(), "at") not in QUIET or any(c.isdigit() for c in w))
        for i in itertools.chain(of_base, marks):
            near.update(range(max(0, i - NEAR), min(len(self), i + NEAR + 1)))
        if not near:
            return []
        keys = {key_of(t.text) for t in map(self.__getitem__, near) if t.distinctive}
        # A similar token need not be marked itself: the name of an address, without its ending.
        return sorted(near | {i for i, w in enumerate(self.words()) if key_of(w) in keys})


def shape(word: str, exact: bool) -> str:
    kinds = "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in word)
    return kinds if exact else re.sub(r"(.)\1+", r"\1", kinds)


def described(found: Tokens, i: int) -> list[str]:
    """Features of a token."""
    t, text = found[i], found.text
    word, digits = t.text, sum(c.isdigit() for c in t.text)
    out = ["any", "s:" + shape(word, False), f"d:{min(digits, 12)}"]
    if digits and len(word) <= 24:
        out.append("x:" + shape(word, True))
    for d in (-3, -2, -1, 1, 2):
        if 0 <= i + d < len(found):
            other = found[i + d].text
            if kind := CUE.get(other.lower()):
                out.append(f"c{d}:{kind}")
            if abs(d) == 1:
                out.append(f"n{d}:{shape(other, False)}")
    if kind := CUE.get(word.lower()):
        out.append("own:" + kind)
    if t.base:
        out.append("base:" + t.base)
    ahead = text[max(0, t.start - 2) : t.start]
    if word[0].isupper() and (not ahead.strip() and (not ahead or "\n" in ahead) or ahead[:1] in ".!?" or ahead[-1:] == "\n"):
        out.append("starts")
    out += [f"before:{ahead[-1]}"] if ahead[-1:] in tuple("(+[<:#") else []
    return out + ([f"after:{text[t.end]}"] if text[t.end : t.end + 1] in tuple(")]:,.") else [])


def linked(found: Tokens, nodes: list[int], first: int, edges: array) -> None:
    """Adds the edges between a text's nodes, which are numbered from first: node, node, type."""
    last: dict[str, int] = {}
    words: dict[int, str] = {}
    for n, i in enumerate(nodes):
        t = found[i]
        if n and nodes[n - 1] == i - 1:
            between = found.text[int(found.spans[i - 1, 1]) : t.start]
            edges.extend((first + n - 1, first + n, BROKEN if re.search(r"[.!?;\n]\s", between + " ") else CHAIN))
        key = key_of(t.text)
        if key in last:
            edges.extend((first + last[key], first + n, SAME if words[last[key]] == t.text else SIMILAR))
        if key in last or t.distinctive:
            words.pop(last.get(key, -1), None)
            last[key], words[n] = n, t.text


class Field:
    """Weights of features by label, and of pairs of labels by type of edge."""

    def __init__(self, names: dict[str, int], node: np.ndarray, pair: np.ndarray) -> None:
        self.names, self.node, self.pair = names, node, pair

    def scores(self, rows: Iterable[list[str]]) -> np.ndarray:
        """Of each node by label, from its features; those that were never met don't count."""
        known, starts = array("q"), array("q")
        for row in rows:  # each has the feature "any"
            starts.append(len(known))
            known.extend(self.names[f] for f in row if f in self.names)
        return np.add.reduceat(self.node[np.array(known)], np.array(starts), axis=0)

    def beliefs(self, scores: np.ndarray, edges: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
        """Marginal probability of each label of each node, by damped loopy message passing."""
        n, k = scores.shape
        first, second, kind = edges.reshape(-1, 3).T
        source, target = np.concatenate([first, second]), np.concatenate([second, first])
        back = np.concatenate([np.arange(len(first), 2 * len(first)), np.arange(len(first))])
        ways = [(t + 4 * d, np.nonzero(kind == t)[0] + d * len(first)) for t in range(4) for d in range(2)]
        pair = np.exp(np.concatenate([self.pair, self.pair.transpose(0, 2, 1)]))
        sent = np.full((len(source), k), -np.log(k))
        gathered = lambda: scores + np.stack([np.bincount(target, sent[:, x], n) for x in range(k)], 1)
        for _ in range(rounds if len(source) else 0):
            out = gathered()[source] - sent[back]
            out = np.exp(out - out.max(1, keepdims=True))
            new = np.empty_like(sent)
            for w, rows in ways:
                new[rows] = out[rows] @ pair[w]
            new = np.log(new / new.sum(1, keepdims=True))
            sent = DAMPING * sent + (1 - DAMPING) * new
        total = gathered()
        total = np.exp(total - total.max(1, keepdims=True))
        return total / total.sum(1, keepdims=True)


#: Drawn documents that the field is trained on.
DRAWN = 900


class Draw:
    """Documents of invented words with personal data in public formats, and where it stands."""

    def __init__(self, seed: int) -> None:
        self.draw = random.Random(seed)

    def pick(self, options: str) -> str:
        return self.draw.choice(options.split("|"))

    def digits(self, form: str) -> str:
        """9: any digit, 8: not 0; a: any letter."""
        d = self.draw
        return "".join(str(d.randint(c == "8", 9)) if c in "98" else d.choice("abcdefghijklmnopqrstuvwxyz") if c == "a" else c for c in form)

    def word(self) -> str:
        parts = "er en ing the on an re at is to ha nd st es or ion le la qui vi eau ré ge ver un lich keit zu ción de os ar ie ti ou wh sh bl".split()
        return "".join(self.draw.choices(parts, k=self.draw.choice((1, 1, 1, 2, 2, 3))))

    def sentence(self) -> str:
        words = [self.word() for _ in range(self.draw.randint(3, 9))]
        if self.draw.random() < 0.5:
            words.insert(self.draw.randint(0, len(words)), self.plain())
        if self.draw.random() < 0.4:
            words.insert(self.draw.randint(0, len(words)), "at")
        made = " ".join([words[0].capitalize(), *words[1:]]) + self.pick(".|.|!|?|.\n")
        return made.upper() if self.draw.random() < 0.1 else made

    def plain(self) -> str:
        """Numbers, marks and words that are no personal data."""
        d = self.digits
        number = self.pick("8|89|aa9aa99aa9a9999aaa9a9aa99|899|8999|899999|1989|2009|8.9|8.9.9|89.9.|8,999|89%|$89.99|89:99|99-99|999-9999|89/99|aaa9|9aa9a99aa9a9|8899-99-99|99.99.2099|2019-89-99|#899|v8.9")
        return self.pick(f"{d(number)}|{d(number)}|{self.word().capitalize()}|{self.word().capitalize()} {self.word().capitalize()}|call {self.word()}|born {self.word()}|at|dot|account {self.word()}")

    def base(self) -> tuple[str, str, str]:
        """A base entity, its shorter form and that form's label."""
        tail = self.digits("899-9999")
        user = self.pick(f"{self.word()}.{self.word()}x|{self.word()}{self.digits('89')}|{self.word()}_{self.word()}")
        return self.draw.choice(
            [
                (f"+{self.digits('8')} ({self.digits('899')}) {tail}", tail, "local_phone"),
                (f"{user}@{self.word()}.example.com", user, "handle"),
                (self.digits("4999 9999 9999 9999"), "", "none"),
                (self.digits("89.89.89.89"), "", "none"),
            ]
        )

    def entity(self, label: str) -> tuple[str, str, str, str]:
        """Words before, the entity, words behind, and its form in a later mention, "" for none."""
        w, p, d = self.word, self.pick, self.digits
        if label == "name":
            first, last = (w() + w()).capitalize(), (w() + w()).capitalize()
            title = p("Mr.|Mrs.|Ms|Dr.|Prof.|Dear|Herr|Frau|Monsieur|Madame|Señor|Señora|named|signed|Sincerely,|Attn:")
            return title, p(f"{first} {last}|{last}"), p(",||."), p(f"{last}|{last}'s|")
        if label == "handle":
            user = p(f"@{w()}{w()}|@{w()}_{w()}|@{w()}{d('89')}")
            return p("||twitter|telegram:|username|follow"), user, "", p(f"{user}|{user[1:]}x|")
        if label == "written_email":
            at, dot = p("at|[at]|(at)"), p("dot|[dot]|(dot)")
            if at != "at" or dot != "dot":
                dot = f"[{dot.strip('[]()')}]"
            return p("write|mail|contact|to|"), f"{w()}{p('|.' + w() + '|' + d('89'))} {at} {w()}{w()} {dot} {p('com|org|net|de|fr')}", "", ""
        if label == "local_phone":
            number = d(p("(899) 899-9999|899-899-9999|099 9999 9999|899 899 9999|0899/999999|899.899.9999"))
            return p("tel|Tel.|phone:|call|mobile|fax:|Telefon|téléphone|teléfono"), number, "", p(f"{number}|")
        if label == "national_id":
            number = d("899-89-9999")
            return p("SSN|ssn:|social security|SSN:|number|"), number, "", p(f"{number}|")
        if label == "account":
            land = p("DE|FR|ES|GB|NL|AT")
            number = land + d(p("89 9999 9999 9999 9999 99|89999999999999999999|89 9999 9999 9999 9999"))
            return p("IBAN|iban:|account|Konto|compte|cuenta|"), number, "", ""
        number = d(p("01.09.1989|19/08/1979|1989-01-19|03/11/1969|29.12.2001"))
        return p("born|born on|DOB:|birth:|geboren am|née le|nacido el|date of birth"), number, "", ""

    def document(self) -> tuple[str, list[tuple[int, int, str]]]:
        """Text, and its spans: those of LABELS, and the base ones that it was made with."""
        pieces: list[tuple[str, str]] = [(self.sentence(), "none") for _ in range(self.draw.randint(1, 3))]
        later = []
        for _ in range(self.draw.choice((0, 1, 1, 2, 3))):
            if self.draw.random() < 0.25:
                long, short, label = self.base()
                pieces.append((self.word(), "none")), pieces.append((long, "base"))
                later += [(short, label)] if short and self.draw.random() < 0.7 else []
            else:
                label = self.draw.choice(LABELS[1:])
                cue, body, after, again = self.entity(label)
                pieces += [(cue, "none")] * bool(cue) + [(body, label)] + [(after, "joined")] * bool(after)
                if again:
                    # A later form with a mark less is the same account; one with a letter more isn't.
                    later.append((again, "none" if again.endswith("x") and label == "handle" else label))
            pieces.append((self.word() + " " + self.sentence(), "none"))
        if self.draw.random() < 0.5:  # a word with a capital that comes again, near a number or not, and is no name
            again = (self.word() + self.word()).capitalize()
            later += [(form, "none") for form in self.draw.sample([again, f"{again}'s", f"{again} {self.digits('89')}", again], 3)]
        for body, label in later:
            pieces += [(self.sentence() + " " + self.word().capitalize() + " " + self.word(), "none"), (body, label), (self.word() + " " + self.sentence(), "none")]
        text, spans = "", []
        for body, label in pieces:
            text += "" if label == "joined" or not text else " "
            if label not in ("none", "joined"):
                spans.append((len(text), len(text) + len(body), label))
            text += body
        return text, spans


def trained(seed: int = 11, drawn: int = DRAWN, steps: int = 300, rate: float = 0.05, decay: float = 3e-5) -> Field:
    """The field, by the composite likelihood of the labels of drawn documents: each node's label given its features, and given these and its neighbours' labels.

    The second part alone would leave it to a node's neighbours to say what its own features can.
    """
    source = Draw(seed)
    rows, labels, edges = [], [], array("q")
    for _ in range(drawn):
        text, spans = source.document()
        found = Tokens(text, in_code_points(text.encode(), base_spans(text.encode())))
        nodes = found.nodes()
        linked(found, nodes, len(rows), edges)
        rows += [described(found, i) for i in nodes]
        for t in map(found.__getitem__, nodes):
            own = next((kind for a, b, kind in spans if a < t.end and t.start < b), "none")
            labels.append(0 if own == "base" else LABELS.index(own))
    seen: dict[str, int] = {}
    for row in rows:
        for f in row:
            seen[f] = seen.get(f, 0) + 1
    names = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n > 1))}
    x = np.zeros((len(rows), len(names)), np.float32)
    for i, row in enumerate(rows):
        x[i, [names[f] for f in row if f in names]] = 1
    y, k = np.array(labels), len(LABELS)
    of_label = np.eye(k, dtype=np.float32)[y]
    # Labels of the neighbours of each node by type of edge, as first and as second node.
    around = np.zeros((2, 4, len(y), k), np.float32)
    for i, j, t in np.array(edges).reshape(-1, 3).tolist():
        around[0, t, j, y[i]] += 1
        around[1, t, i, y[j]] += 1
    weights = np.zeros(len(names) * k + 4 * k * k)
    mean, square = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, steps + 1):
        node, pair = weights[: len(names) * k].reshape(-1, k).astype(np.float32), weights[len(names) * k :].reshape(4, k, k).astype(np.float32)
        alone = x @ node
        both = alone + sum(around[0, t] @ pair[t] + around[1, t] @ pair[t].T for t in range(4))
        off = []
        for logits in (alone, both):
            p = np.exp(logits - logits.max(1, keepdims=True))
            off.append(p / p.sum(1, keepdims=True) - of_label)
        slope = np.stack([around[0, t].T @ off[1] + (around[1, t].T @ off[1]).T for t in range(4)])
        full = np.concatenate([(x.T @ (off[0] + off[1])).ravel(), slope.ravel()]) / len(y) + decay * weights
        mean, square = 0.9 * mean + 0.1 * full, 0.999 * square + 0.001 * full**2
        weights = weights - rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return Field(names, weights[: len(names) * k].reshape(-1, k), weights[len(names) * k :].reshape(4, k, k))


@functools.cache
def field() -> Field:
    """The field, trained once in a process."""
    return trained()


STARTS = re.compile(rb"[0-9@]")
MARKS = bytes(32 if c < 128 and not chr(c).isalnum() and c != 95 else c for c in range(256))


def worth(text: bytes) -> bool:
    """Whether a text has anything that a field could start from: a digit, an account mark or a cue word."""
    if STARTS.search(text):
        return True
    low = text.lower() if text.isascii() else text.decode().lower().encode()
    return not STARTING.isdisjoint(low.translate(MARKS).split())


def labelled(texts: list[tuple[str, list[tuple[int, int, str]]]], model: Field) -> list[list[tuple[int, int, str]]]:
    """Spans of the method in each text (with its base spans), in code points."""
    made, edges, at = [], array("q"), 0
    for text, base in texts:
        found = Tokens(text, base)
        nodes = found.nodes()
        linked(found, nodes, at, edges)
        made.append((found, nodes))
        at += len(nodes)
    if not at:
        return [[] for _ in texts]
    scores = model.scores(described(found, i) for found, nodes in made for i in nodes)
    beliefs = model.beliefs(scores, np.array(edges, np.int64).reshape(-1, 3))
    best, sure, at, out = beliefs.argmax(1), beliefs.max(1), 0, []
    for found, nodes in made:
        spans, run = [], []

        def ended(spans: list, run: list, found: Tokens) -> None:
            if run and np.mean([p for _, _, p in run]) >= CONFIDENCE:
                spans.append((int(found.spans[run[0][0], 0]), int(found.spans[run[-1][0], 1]), LABELS[run[0][1]]))
            run.clear()

        for n, i in enumerate(nodes, at):
            label = int(best[n])
            if run and (run[-1][1] != label or run[-1][0] != i - 1):
                ended(spans, run, found)
            if label and not found[i].base:
                run.append((i, label, sure[n]))
        ended(spans, run, found)
        out.append(spans)
        at += len(nodes)
    return out


def joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in sorted(found, key=lambda s: (s[0], KINDS.index(s[2]))))


FIELDS = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in BASE_KINDS], ("base_sha256", pa.string()), ("spans", pa.string())])


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    common.bounded_batches(docs.sparkSession)
    model = field()  # a few thousand numbers, sent with the task

    def rows(ids: list, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        bases = [in_code_points(t, base_spans(t)) for t in texts]
        asked = [i for i, t in enumerate(texts) if worth(t)]
        more = dict(zip(asked, labelled([(texts[i].decode(), bases[i]) for i in asked], model), strict=True))
        out = []
        for i, (doc_id, base) in enumerate(zip(ids, bases, strict=True)):
            own = [sum(s[2] == k for s in base) for k in BASE_KINDS]
            out.append((doc_id, *own, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more.get(i, []))))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), FIELDS, strict=True)], schema=FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, size = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), common.raw(batch.column(1)), strict=True):
                ids.append(doc_id), texts.append(text)
                size += len(text)
                if size > 32 * NODES:
                    yield from rows(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield from rows(ids, texts)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(common.table(spark, sf_dir, "documents"))
