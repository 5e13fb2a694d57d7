"""Personal data: base patterns, and a linear-chain CRF over word shapes that adds what they miss, decoded by Viterbi in numpy batches.

The CRF reads every token of every text, by its type: a class of cue words or a shape. It is fitted on a small labelled table, made
by rule from the phrases and forms below. Most tokens are so surely no personal data that no path through another label can be the
best one; a bound proves that in one vector step, and Viterbi decodes the stretches between them, with the whole text's best path
as result.
"""
from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braid.llm import crf
from braid.llm.batches import over_texts
from braid.llm.common import documents, text_or_empty

BASE = ("email", "ip", "card", "phone")
ADDED = ("email", "phone", "iban", "name", "passport", "secret", "ssn")
ORDER = {k: i for i, k in enumerate([*BASE, *sorted(set(ADDED) - set(BASE))])}
LABELS = ["O", *(p + k for k in ADDED for p in ("B-", "I-"))]

HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a run of digits that can't start a match can't start one at its later digits either, so only starts of runs are tried
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT_OR_AT = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str):
    """Each @ in turn with the longest run before it that no earlier match has taken: the leftmost matches of
    [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+ without overlap, in time that follows the text's length."""
    taken, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > taken and text[start - 1] in LOCAL:
            start -= 1
        m = HOST.match(text, at + 1) if start < at else None
        if m:
            taken = m.end()
            yield start, taken
        else:
            taken = at + 1
        at = text.find("@", max(taken, at + 1))


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base kinds' matches, leftmost and without overlap within a kind; those that fail their check are dropped, not retried."""
    if not DIGIT_OR_AT.search(text):
        return []
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(d := p.lstrip("0")) <= 3 and int(d or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], ORDER[s[0]]))


#: Every character of a text is in some token, so offsets are running sums of lengths.
TOKEN = re.compile(r"\s+|[^\W_]+|[^\w\s]|_")
#: Words that announce personal data, or say that a number is something else, by class.
CUES = {
    "title": "mr mrs ms miss dr prof sir madam herr frau monsieur madame mme don doña",
    "name": "name named nombre nom",
    "who": "to from by with contact cc attn regards sincerely signed hi hello dear ask meet patient customer tenant",
    "is": "is am was are",
    "my": "my his her their your",
    "phone": "phone tel telephone call mobile cell fax whatsapp",
    "ssn": "ssn social security",
    "iban": "iban account",
    "passport": "passport",
    "password": "password passwd pwd passphrase pass",
    "token": "token secret bearer credential",
    "key": "key apikey",
    "api": "api access auth private client db",
    "prefix": "sk pk ghp gho ghs xoxb xoxp glpat",
    "live": "live test prod",
    "at": "at",
    "dot": "dot",
    "other": "version page year order section chapter isbn vol line item invoice part figure room",
    "the": "the a an of for in on and or",
}
CUE = {word: i for i, words in enumerate(CUES.values(), 1) for word in words.split()}
#: Common given names.
GIVEN = """Ahmed Aisha Alan Alice Amir Ana Andrea Anna Antonio Carlos Chen Clara Daniel David Elena Emily Emma Eva Fatima Felix Frank Grace
Hans Helen Ines Ivan James Jan Jane Javier John Jose Juan Julia Karl Laura Lena Linda Lucas Luis Maria Marie Mark Martin Mary Michael Mohammed
Nina Olga Omar Paul Peter Pierre Priya Robert Rosa Sara Sarah Sofia Susan Thomas Wei William Wolfgang Yuki""".split()
KINDS = len(CUES) + 1
PAD_TYPE, GIVEN_TYPE = 0, KINDS
LENGTHS = (4, 8, 12, 20, 32)
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
DIGITS_TYPE = GIVEN_TYPE + 1
ALPHA_TYPE = DIGITS_TYPE + 15
MIXED_TYPE = ALPHA_TYPE + 7
PUNCTUATION_TYPE = MIXED_TYPE + 8 * (len(LENGTHS) + 1)
TYPES = PUNCTUATION_TYPE + len(PUNCTUATION) + 1
#: Types of white space, which isn't a token of the chain: it says how its neighbours are apart.
SPACE, NEWLINE = TYPES, TYPES + 1
PADS = 5


class Types(dict):
    """The type of each token: a class of cues, a given name, or the token's shape. A type is all that the model sees of a token."""

    def __missing__(self, token: str) -> int:
        if len(self) > 200_000:
            self.clear()
        t = self[token] = self.of(token)
        return t

    @staticmethod
    def of(token: str) -> int:
        if token.isspace():
            return NEWLINE if "\n" in token else SPACE
        cue = CUE.get(token.lower())
        if cue:
            return cue
        if token.isascii() and token.isdigit():
            n = len(token)
            return DIGITS_TYPE + (n - 1 if n <= 13 else 13 if n <= 19 else 14)
        if token.isalpha():
            if token.istitle() or len(token) == 1 and token.isupper():
                return GIVEN_TYPE if token in GIVEN_SET else ALPHA_TYPE + (len(token) > 1)
            if token.islower():
                return ALPHA_TYPE + 2 + (len(token) > 1)
            return ALPHA_TYPE + (4 if token.isupper() else 5 if token.isascii() else 6)
        if token.isalnum():
            low = token.lower()
            turns = sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:]))
            kind = 4 * all(c in "0123456789abcdef" for c in low) + 2 * token.isupper() + (turns > 1)
            return MIXED_TYPE + kind * (len(LENGTHS) + 1) + sum(len(token) >= n for n in LENGTHS)
        return PUNCTUATION_TYPE + (PUNCTUATION.index(token) if token in PUNCTUATION else len(PUNCTUATION))


GIVEN_SET = frozenset(GIVEN)


def chain(texts: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The types of all tokens but white space, one text after another with PADS between; how each is apart from the token before
    (0 not at all, 1 by spaces, 2 by a line's end or a text's); and its number among all tokens of all texts, -1 for pads."""
    pads = [PAD_TYPE] * PADS
    flat = np.array(pads + [t for types in texts for t in (*types, *pads)], np.int16)
    space = flat >= TYPES
    apart = np.zeros(len(flat), np.int8)
    apart[1:] = np.where(flat[:-1] == NEWLINE, 2, flat[:-1] == SPACE)
    apart[flat == PAD_TYPE] = 2
    apart[1:][flat[:-1] == PAD_TYPE] = 2
    number = np.where(flat == PAD_TYPE, -1, np.cumsum(flat != PAD_TYPE) - 1)
    return flat[~space].astype(np.int64), apart[~space].astype(np.int64), number[~space]


#: Sizes of the feature templates: types of the token and its neighbours, alone and in pairs, the last cue of the five tokens
#: before, and how the token is apart from both neighbours.
SIZES = [TYPES] * 3 + [TYPES * TYPES] * 4 + [KINDS * TYPES, 9 * TYPES]
SLOTS = len(SIZES)


def templates(q: np.ndarray, apart: np.ndarray) -> list[np.ndarray]:
    """The feature numbers of each token in each template."""

    def at(x, k):
        return np.concatenate([x[k:], np.zeros(k, x.dtype)]) if k > 0 else np.concatenate([np.zeros(-k, x.dtype), x[:k]])

    before, after = at(q, -1), at(q, 1)
    last = np.zeros_like(q)
    for k in range(5, 0, -1):
        near = at(q, -k)
        last = np.where((near > 0) & (near < KINDS), near, last)
    return [q, before, after, at(q, -2) * TYPES + before, after * TYPES + at(q, 2), before * TYPES + q, q * TYPES + after, last * TYPES + q, (apart * 3 + at(apart, 1)) * TYPES + q]


#: Family names of the labelled table.
FAMILY = "Smith Garcia Keller Rossi Novak Dubois Okafor Tanaka Larsen Moreau Weber Silva Haddad Kowalski Nguyen Petrov Murphy Cohen".split()


def labelled_table(n: int, seed: int) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Texts and their spans. Odd rows hold one kind's form in plain words, even rows things that look alike but aren't personal."""
    r = random.Random(seed)
    lower, upper, hexa = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
    both = lower + upper + "0123456789"

    def d(k):
        return "".join(r.choice("0123456789") for _ in range(k))

    def some(alphabet, k):
        return "".join(r.choice(alphabet) for _ in range(k))

    def plain():
        if r.random() < 0.25:
            return r.choice("the a of to in and for on with is was by from at my her order".split())
        return some("aeioust", 1) + some("abcdefghilmnoprstuv" if r.random() < 0.8 else "abcdeéèfghilmnñoprsßtuüv", r.randrange(1, 9))

    def word():
        w = plain()
        return w.title() if r.random() < 0.12 else w

    def words(k):
        return " ".join(word() + (r.choice(",.") if r.random() < 0.15 else "") for _ in range(k))

    def cap():
        return r.choice(FAMILY) if r.random() < 0.5 else some(upper, 1) + some("aeiourstln", r.randrange(2, 8))

    def person(known=True):
        first = r.choice(GIVEN) if known else cap()
        return " ".join([first, *(cap() for _ in range(r.choice([1, 1, 1, 2])))]) if r.random() < 0.85 else f"{first} {some(upper, 1)}. {cap()}"

    def mixed(k):
        return some(both, k - 2) + r.choice(lower) + d(1)

    def phone():
        return r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}"])

    def iban():
        grouped = f"{some(upper, 2)}{d(2)}" + "".join(f" {d(4)}" for _ in range(r.randrange(3, 6))) + r.choice(["", f" {d(2)}", f" {d(3)}"])
        return r.choice([grouped, f"{some(upper, 2)}{d(r.randrange(16, 24))}", f"{some(upper, 2)}{d(2)} {some(upper, 4)} {d(4)} {d(4)} {d(4)} {d(2)}", f"{some(upper, 2)}{d(2)}{some(upper, 4)}{d(r.randrange(10, 15))}", f"{some(upper, 2)}{d(2)} {d(4)} {d(4)} {d(4)} {d(1)}{some(upper, 1)}{d(2)} {d(3)}"])

    def secret():
        return r.choice([lambda: f"AKIA{some(upper + '0123456789', 15)}{d(1)}", lambda: f"{r.choice(['sk', 'pk'])}_{r.choice(['live', 'test'])}_{mixed(24)}", lambda: f"{r.choice(['ghp', 'gho', 'ghs'])}_{mixed(36)}", lambda: f"sk-{mixed(40)}", lambda: f"eyJ{mixed(17)}.eyJ{mixed(30)}.{mixed(27)}", lambda: f"xoxb-{d(11)}-{mixed(24)}"])()

    def keyed():
        return r.choice([lambda: some(hexa, r.choice([32, 40, 64])), lambda: mixed(r.randrange(16, 41)), lambda: some(hexa, r.choice([16, 20, 24]))])()

    def password():
        return r.choice([lambda: mixed(r.randrange(8, 20)), lambda: some(hexa, r.choice([12, 16, 18, 20])), lambda: plain() + d(r.randrange(1, 5)), lambda: plain().title() + d(2)])()

    def noise():
        return r.choice(["", " "]) + r.choice("!#$%&*?.,;:|-") * r.randrange(1, 4)

    assign = [" = ", "=", ": ", " ", '="', ': "', ' = "', "='", " = '", " is "]
    personal = {
        "email": [lambda: ("", f"{some(lower, r.randrange(3, 8))} at {some(lower, r.randrange(4, 9))} dot {r.choice(['com', 'org', 'net', 'de'])}"), lambda: ("", f"{some(lower, 4)}.{some(lower, 5)} at {some(lower, 6)} dot com"), lambda: ("", f"{some(lower, 5)} (at) {some(lower, 6)} (dot) com"), lambda: ("", f"{some(lower, 5)}.{some(lower, 4)} [at] {some(lower, 6)} [dot] org")],
        "phone": [lambda: ("", phone()), lambda: (r.choice(["call ", "phone: ", "Tel. ", "tel: ", "mobile ", "fax "]), r.choice([phone(), f"{d(3)} {d(3)} {d(4)}", f"0{d(2)} {d(4)} {d(4)}", f"0{d(3)} {d(7)}", d(10)]))],
        "iban": [lambda: ("", iban()), lambda: (r.choice(["IBAN ", "iban: ", "IBAN: ", "account "]), iban())],
        "name": [lambda: (r.choice(["Mr. ", "Mrs. ", "Ms. ", "Dr. ", "Mr ", "Dr ", "Prof. ", "Frau ", "Herr "]), person(r.random() < 0.6)), lambda: (r.choice(["my name is ", "Name: ", "name is ", "Regards, ", "signed by "]), person(r.random() < 0.6)), lambda: (f"{plain()} {r.choice(['to', 'from', 'by', 'with', 'contact', 'ask'])} ", person()), lambda: (f"{plain()} ", person())],
        "secret": [lambda: ("", secret()), lambda: (r.choice(["token", "secret", "api_key", "access_token", "key", "client_secret", "Authorization: Bearer"]) + r.choice(assign[:-1]), r.choice([keyed, secret])()), lambda: (r.choice(["password", "pwd", "passwd", "db_password", "Password", "PASSWORD"]) + r.choice(assign), password())],
        "ssn": [lambda: (r.choice(["", "SSN ", "ssn: ", "SSN: ", "social security ", "social security number "]), f"{d(3)}-{d(2)}-{d(4)}"), lambda: (r.choice(["SSN ", "ssn: "]), f"{d(3)} {d(2)} {d(4)}")],
        "passport": [lambda: (r.choice(["passport ", "Passport: ", "passport no. ", "passport number ", "Passport No: "]), r.choice([f"{some(upper, 1)}{d(8)}", f"{some(upper, 2)}{d(7)}", d(9)]))],
    }
    alike = [
        lambda: f"version {d(1)}.{d(1)}", lambda: f"{r.randrange(1900, 2030)}-{r.randrange(10, 13)}-{r.randrange(10, 31)}", lambda: f"in {r.randrange(1900, 2030)}", lambda: d(r.choice([1, 2, 3, 4, 5, 6, 8, 9, 10, 11, 12, 16])), lambda: f"{d(2)}.{d(2)} percent",
        lambda: f"{d(3)}.{d(3)}.{d(2)}.{d(3)}", lambda: f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", lambda: f"{some(lower, 6)}.{d(2)}@mail{d(1)}.example.com", lambda: f"{d(4)} {d(4)} {d(4)} {d(4)}",
        lambda: f"the name of {word()}", lambda: f"a token of {word()}", lambda: f"the secret {plain()}", lambda: f"{plain()} at {plain()}", lambda: f"order {d(5)}-{d(2)}", lambda: f"page {d(2)}-{d(3)}", lambda: f"the dot is {plain()}", lambda: f"{plain()}{d(2)}", lambda: f"{plain()}***", lambda: f"{d(2)}:{d(2)}",
        lambda: f"{cap()} {plain()}, Version {d(1)}.0.", lambda: f"a password for {plain()}", lambda: f"password, {plain()}", lambda: f"{plain()} the {cap()} {cap()} {plain()}", lambda: f"{plain()} in {cap()} {cap()}", lambda: f"{plain()}. {cap()} {plain()}", lambda: f"call {plain()} {plain()}", lambda: f"isbn {d(3)}-{d(1)}-{d(2)}-{d(6)}-{d(1)}",
        lambda: f"licensed under the {cap()} License", lambda: f"call {d(2)}", lambda: f"account of {plain()}", lambda: f"key {plain()}", lambda: f"a passport for {plain()}", lambda: f"{cap()} {cap()}", lambda: f"{some(lower, 4)}_{some(lower, 5)}_{d(1)}", lambda: f"id {some(hexa, 8)}", lambda: f"{cap()}, {cap()} {plain()}", lambda: f"http://{plain()}.org/{plain()}/{d(4)}",
        lambda: " ".join(word() + noise() for _ in range(r.randrange(2, 6))), lambda: f"{plain()}{noise()} {cap()}{noise()}", lambda: " ".join(plain().upper() + noise() for _ in range(3)), lambda: ".".join(d(r.randrange(1, 4)) for _ in range(4)), lambda: f"{plain()}. {r.choice(GIVEN)} {plain()}",
        lambda: f"{plain()}\n{cap()} {plain()}", lambda: f"{plain()}. {cap()} {cap()} {plain()}", lambda: f"{r.choice('abcdefghij')}. {plain()}", lambda: f"{plain()} {d(3)} {plain()}", lambda: f"| {plain()} | {cap()} | {plain()} |", lambda: f"{plain()} {plain()}".upper(), lambda: " ".join([some("aéoñxç", 1)] * r.randrange(2, 9)), lambda: f"{cap()[:1]}. {cap()[:1]}. {cap()}", lambda: " ".join([plain().title()] * r.randrange(2, 9)), lambda: f"{plain()} the {cap()} {cap()} {cap()} {plain()}",
        lambda: " ".join([r.choice(["at", "At", "dot", "to"])] * r.randrange(2, 6)),
    ]
    kinds = [*personal, "secret", "name", "iban"]  # these have the most forms
    out = []
    for i in range(n):
        head, tail = words(r.randrange(0, 6)), words(r.randrange(0, 6))
        kind = kinds[i // 2 % len(kinds)]
        before, value = r.choice(personal[kind])() if i % 2 else ("", r.choice(alike)())
        gap = r.choice([" ", " ", " ", "\n"]) if head else ""
        start = len(head) + len(gap) + len(before)
        close = before[-1] if before[-1:] in ("'", '"') else ""
        text = f"{head}{gap}{before}{value}{close}{r.choice([' ', '. ', ', ', chr(10), '*** ', '%%% '])}{tail}"
        out.append((text, [(kind, start, start + len(value))] if i % 2 else []))
    return out


class Tagger:
    """A linear-chain CRF over types. weights has a table [feature, label] for each template; pairs of tables are summed before."""

    def __init__(self, weights: list[np.ndarray], trans: np.ndarray):
        own, before, after, two_before, two_after, *rest = weights
        by_before = two_before.reshape(TYPES, TYPES, -1) + before[None]
        by_after = two_after.reshape(TYPES, TYPES, -1) + after[:, None]
        last = rest[-1].reshape(9, TYPES, -1) + own[None]
        shape = (-1, len(LABELS))
        self.tables = [x.reshape(shape).astype(np.float32) for x in (by_before, by_after, *rest[:-1], last)]
        self.trans = trans.astype(np.float32)
        # what a label other than O can gain at most by its transitions, over O there, and B- after it where that was I-
        n = len(LABELS)
        legal = self.trans > -1e3
        turned = np.array([j - 1 if LABELS[j][0] == "I" else j for j in range(n)])  # I-k as B-k
        into = np.where(legal, self.trans - self.trans[:, :1], -np.inf).max(axis=0)
        out = np.where(legal, self.trans - self.trans[0, turned][None], -np.inf).max(axis=1)
        inside = np.array([i for i in range(n) if LABELS[i][0] == "I"])
        late = max(0.0, float(np.where(legal[inside], self.trans[inside] - self.trans[inside - 1], -np.inf).max()))
        self.gain, self.inside = (into + out + late + 1e-3).astype(np.float32), inside

    def emissions(self, q: np.ndarray, apart: np.ndarray) -> np.ndarray:
        out = np.zeros((len(q), len(LABELS)), np.float32)
        for table, x in zip(self.tables, templates(q, apart)[3:]):
            out += table[x]
        return out

    def certain(self, emit: np.ndarray) -> np.ndarray:
        """Tokens that are O on the best path whatever stands around them: O beats every label by more than that can gain."""
        turn = np.maximum((emit[:, self.inside] - emit[:, self.inside - 1]).max(axis=1), 0)
        turn = np.append(turn[1:], np.float32(0))
        return emit[:, 0] - turn > (emit[:, 1:] + self.gain[1:]).max(axis=1)

    def labels(self, q: np.ndarray, apart: np.ndarray, whole: bool = False) -> np.ndarray:
        """The best path. Pads are O; so are certain tokens, and what lies between them is decoded by itself, which gives the same
        path. whole decodes from pad to pad."""
        emit = self.emissions(q, apart)
        sure = q == PAD_TYPE
        if not whole:
            sure |= self.certain(emit)
        out = np.zeros(len(q), np.int8)
        open_ = np.flatnonzero(~sure)
        if not len(open_):
            return out
        cut = np.flatnonzero(np.diff(open_, prepend=-9) > 1)
        starts, lengths = open_[cut], np.diff(cut, append=len(open_))
        order = np.argsort(lengths, kind="stable")
        i = 0
        while i < len(order):
            # like lengths together, up to BUDGET tokens of padding and all
            wide = int(lengths[order[i]])
            j = i + max(1, min(BUDGET // (wide + 8), int(np.searchsorted(lengths[order], wide + wide // 4 + 1, "right")) - i))
            at, n = starts[order[i:j]], lengths[order[i:j]]
            place = at[:, None] + np.minimum(np.arange(int(n.max())), n[:, None] - 1)
            scores = emit[place]
            scores[np.arange(len(n)), n - 1] += self.trans[:, 0]  # O follows
            path = crf.viterbi(scores, n, self.trans, self.trans[0])
            real = path >= 0
            out[place[real]] = path[real]
            i = j
        return out

    def spans(self, texts: list[str], types: Types | None = None, whole: bool = False) -> list[list[tuple[str, int, int]]]:
        """The CRF's spans in each text: every token of every text is read."""
        types = Types() if types is None else types
        tokens = [TOKEN.findall(t) for t in texts]
        q, apart, number = chain([list(map(types.__getitem__, t)) for t in tokens])
        found = self.labels(q, apart, whole)
        out: list[list] = [[] for _ in texts]
        hits = np.flatnonzero(found)
        if not len(hits):
            return out
        ends = np.cumsum([len(t) for t in tokens])
        ids = number[hits]
        owner = np.searchsorted(ends, ids, "right")
        offsets: dict[int, list[int]] = {}
        for i, n, tag in zip(owner.tolist(), ids.tolist(), found[hits].tolist()):
            if i not in offsets:
                offsets[i] = np.concatenate([[0], np.cumsum([len(t) for t in tokens[i]])]).tolist()
            k = n - (int(ends[i]) - len(tokens[i]))
            kind, end = LABELS[tag][2:], offsets[i][k + 1]
            if LABELS[tag][0] == "B":
                out[i].append((kind, offsets[i][k], end))
            else:
                out[i][-1] = (kind, out[i][-1][1], end)
        return out


#: Tokens that Viterbi decodes at once.
BUDGET = 100_000


def tagged(text: str, spans) -> tuple[np.ndarray, list[np.ndarray]]:
    """The labels and features of a text's tokens, with one pad at each end."""
    q, apart, number = chain([list(map(Types.of, TOKEN.findall(text)))])
    ends = np.cumsum([len(t) for t in TOKEN.findall(text)])
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
    tags = np.zeros(len(q), np.int64)
    for kind, a, b in spans:
        inside = [i for i, n in enumerate(number) if n >= 0 and a <= starts[n] and ends[n] <= b]
        tags[inside] = LABELS.index("I-" + kind)
        tags[inside[:1]] = LABELS.index("B-" + kind)
    part = slice(PADS - 1, len(q) - PADS + 1)
    return tags[part], [x[part] for x in templates(q, apart)]


@lru_cache(2)
def tagger(rows: int = 2400, seed: int = 1) -> Tagger:
    """Fitted on the driver; rows and seed are those of the labelled table."""
    data = [tagged(*row) for row in labelled_table(rows, seed)]
    first = np.cumsum([0, *SIZES])[:-1]
    numbers = [np.stack([x + at for x, at in zip(features, first)], axis=1) for _, features in data]
    used, small = np.unique(np.concatenate(numbers), return_inverse=True)
    small = small.reshape(-1, SLOTS) + 1
    cuts = np.cumsum([len(x) for x in numbers])[:-1]
    x, lengths = crf.padded(np.split(small, cuts))
    y, _ = crf.padded([tags for tags, _ in data])
    weights, trans, _ = crf.fit(x, y, lengths, len(used) + 1, len(LABELS), rounds=90, l2=2e-5)
    for kind in ADDED:  # I- follows only its own kind
        i = LABELS.index("I-" + kind)
        allowed = [LABELS.index("B-" + kind), i]
        trans[[j for j in range(len(LABELS)) if j not in allowed], i] = -1e4
    dense = np.zeros((sum(SIZES), len(LABELS)))
    dense[used] = weights[1:]
    return Tagger(np.split(dense, first[1:]), trans)


def free(spans: list, base: list) -> list:
    """The spans that overlap none of base. Both are sorted by start, and spans don't overlap each other."""
    out, reach, i = [], 0, 0
    for kind, a, b in spans:
        while i < len(base) and base[i][1] < b:
            reach = max(reach, base[i][2])
            i += 1
        if reach <= a:
            out.append((kind, a, b))
    return out


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Tagger | None = None) -> DataFrame:
    """One row per input row: id_col, base and spans, both array<struct<kind, start, end>> (code points, end exclusive).

    spans are the base ones and the CRF's that overlap none of them. Null and empty texts have none. Whole texts of any length;
    nothing is shuffled. Rows are read one by one, so repeated rows give equal rows and null ids stay; spans with one start are in
    the order of their kinds. An empty table gives an empty result. Other columns are ignored.
    """
    model = model or tagger()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def make():
        types = Types()

        def f(batch):
            texts = batch.column(1).to_pylist()
            base = [base_spans(t) for t in texts]
            every = [sorted(own + free(more, own), key=lambda s: (s[1], ORDER[s[0]])) for own, more in zip(base, model.spans(texts, types))]
            columns = [pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in x], kind) for x in (base, every)]
            return pa.RecordBatch.from_arrays([batch.column(0), *columns], [id_col, "base", "spans"])

        return f

    rows = docs.select(F.col(id_col), text_or_empty(text_col).alias("__text"))
    spans = "array<struct<kind:string,start:int,end:int>>"
    return over_texts(rows, "__text", make, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, base {spans}, spans {spans}")


def op8_pii(spark, sf_dir: str) -> DataFrame:
    def text(col):
        return F.array_join(F.transform(col, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    found = find_personal_data(documents(spark, sf_dir))
    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, BASE), F.sha2(text("base").cast("binary"), 256).alias("base_sha256"), text("spans").alias("spans"))
