"""Mapping free-entered values to a canonical list (problem 5).

Values and names are brought to one spelling (compatibility forms, lower case, marks to spaces). Then, for each value:

1. An Aho-Corasick automaton over all names and aliases finds the mentions inside it. Latin mentions must stand between word borders. Of
   overlapping ones the longest wins, left to right. The value belongs to the concept of its longest mention if what is left of it says
   nothing else: qualifiers, also with one typing error, and fillers, but no word or character that names of the list are built with.
2. Values without such a mention go to token-set similarity, in whatever order the tokens stand. A token of the value is near one of a name if
   typing errors (insertion, deletion, substitution, swap of neighbours) make up at most `token_errors` of the longer one; a run of Chinese is
   one token. Tokens weigh by inverse document frequency in the list, so receptor weighs less than the name before it. The similarity of two
   sets is the weight of the intersection, each token less its share of errors, over the weight of the intersection and of both rests; it must
   reach `least_similarity`. Where spaces were moved or left out, the tokens are compared as one, in the order typed and with the part after a
   comma put first, with at most `joined_errors` of errors. Codes (letters and digits without a vowel pattern of words) never match by
   similarity, since each letter of a code tells it from others.
3. All others are `unmatched`.

The canonical list is curated and small by contract: more than `most_names` names raise an error instead of being broadcast. Values are
mapped where they lie, without a shuffle; a value that holds a third of all rows costs one look into the worker's memo for each row.

Cases: null and blank values give no row; an id that comes several times gives one row (with the smallest concept, if its values differ);
an empty list maps everything to `unmatched`; names shared by two concepts go to the smaller concept id, and so do ties of similarity.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.operators.packed_fields import parse
from corvane.session import checked_broadcast_rows

# Words that qualify a concept without making another one, and fillers around it.
QUALIFIERS_EN = "the a an of in with for severe mild moderate suspected probable possible confirmed acute chronic recurrent adult adults child children paediatric pediatric patient patients nos unspecified".split()
QUALIFIERS_ZH = "重度 轻度 中度 疑似 可疑 确诊 急性 慢性 复发性 原发性 继发性 患者 成人 儿童 老年 类 的".split()
UNMATCHED = "unmatched"
TOKEN_ERRORS, JOINED_ERRORS, LEAST_SIMILARITY = 0.24, 0.14, 0.75
HAN = "[㐀-鿿豈-﫿]"


def spelling(text: str) -> str:
    """One spelling: compatibility forms, lower case, marks and spaces to one space, none between Chinese characters."""
    s = unicodedata.normalize("NFKC", text).casefold()
    s = "".join(c for c in s if unicodedata.category(c) != "Cf")
    s = re.sub(r"[\W_]+", " ", s).strip()
    return re.sub(f"(?<={HAN}) (?={HAN})", "", s)


def is_code(name: str) -> bool:
    return re.fullmatch(r"[a-z]{2,6} ?\d{0,3}|([a-z] ){2,6}[a-z]?( ?\d){0,3}", name) is not None and not re.search(r"[aeiou].*[aeiou]", name)


def within(a: str, b: str, most: int) -> int:
    """Optimal string alignment distance, or most + 1 beyond it."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            now.append(d)
        if min(now) > most:
            return most + 1
        before, last = last, now
    return last[-1]


def pairs_of(s: str) -> Counter:
    s = f"^{s}$"
    return Counter(s[i : i + 2] for i in range(len(s) - 1))


class Grams:
    """Strings by their pairs of letters: an error changes three of them at most, so all that are near share enough."""

    def __init__(self, strings: list[str]):
        self.strings, self.index = strings, defaultdict(list)
        for i, x in enumerate(strings):
            for p, k in pairs_of(x).items():
                self.index[p].append((i, k))

    def near(self, s: str, share: float) -> list[tuple[str, float]]:
        """(string, errors by length of the longer one) up to the share."""
        shared: Counter = Counter()
        for p, k in pairs_of(s).items():
            for i, m in self.index.get(p, ()):
                shared[i] += min(k, m)
        out = []
        for i, k in shared.items():
            x = self.strings[i]
            longer = max(len(x), len(s))
            most = int(share * longer + 1e-9)
            if k >= longer + 1 - 3 * most and (d := within(s, x, most)) <= most:
                out.append((x, d / longer))
        return out


class Mapper:
    """The compiled list. names: (spelling, concept id)."""

    def __init__(self, names: list[tuple[str, str]], token_errors: float = TOKEN_ERRORS, joined_errors: float = JOINED_ERRORS, least_similarity: float = LEAST_SIMILARITY):
        self.token_errors, self.joined_errors, self.least_similarity, self.memo = token_errors, joined_errors, least_similarity, {}
        self.names: dict[str, str] = {}
        for n, c in names:
            if (s := spelling(n)) and (s not in self.names or c < self.names[s]):
                self.names[s] = c
        self.codes = {re.sub(r"\W", "", n): c for n, c in sorted(self.names.items(), reverse=True) if is_code(n)}
        self.automaton = ahocorasick.Automaton()
        for n, c in self.names.items():
            if not is_code(n):
                self.automaton.add_word(n, (n, c))
        if len(self.automaton):
            self.automaton.make_automaton()
        words = Counter(w for n in self.names for w in n.split() if not re.search(HAN, w))
        self.words = {w for w, k in words.items() if len(w) > 1} - set(QUALIFIERS_EN)
        han = Counter(x for n in self.names if re.search(HAN, n) for x in set(re.sub(f"[^{HAN[1:-1]}]", "", n)))
        self.han = set(han) - set("".join(QUALIFIERS_ZH))
        self.near_memo: dict[str, list[tuple[str, float]]] = {}
        plain = [n for n in sorted(self.names) if not is_code(n)]
        self.sets = [(tuple(n.split()), self.names[n]) for n in plain]
        self.holding: dict[str, list[int]] = defaultdict(list)  # token -> names that hold it
        for i, (tokens, _) in enumerate(self.sets):
            for t in set(tokens):
                self.holding[t].append(i)
        self.weight = {t: math.log(1 + len(plain) / len(held)) for t, held in self.holding.items()}
        self.unknown = math.log(1 + max(1, len(plain)))
        self.tokens = Grams(list(self.holding))
        self.joined = Grams(sorted({n.replace(" ", "") for n in plain}))
        self.concept: dict[str, str] = {}
        for n in plain:
            flat = n.replace(" ", "")
            self.concept[flat] = min(self.names[n], self.concept.get(flat, self.names[n]))

    def mentions(self, s: str) -> list[tuple[int, int, str]]:
        if not len(self.automaton):
            return []
        found = []
        for end, (n, c) in self.automaton.iter(s):
            start = end - len(n) + 1
            left_ok = start == 0 or not (s[start - 1].isalnum() and s[start].isascii() and s[start - 1].isascii())
            right_ok = end + 1 == len(s) or not (s[end + 1].isalnum() and s[end].isascii() and s[end + 1].isascii())
            if left_ok and right_ok:
                found.append((start, end + 1, c))
        found.sort(key=lambda m: (m[0] - m[1], m[0], m[2]))
        kept: list[tuple[int, int, str]] = []
        for m in found:
            if all(m[1] <= k[0] or m[0] >= k[1] for k in kept):
                kept.append(m)
        return kept

    def says_nothing(self, rest: str) -> bool:
        for w in rest.split():
            if re.search(HAN, w):
                if not any(within(w, q, 1 if len(q) > 1 else 0) <= 1 and (len(w) > 1 or w == q) for q in QUALIFIERS_ZH) and not self.stripped_zh(w) == "" and set(w) & self.han:
                    return False
            elif w not in QUALIFIERS_EN and not any(len(q) > 3 and within(w, q, 1) <= 1 for q in QUALIFIERS_EN) and (w in self.words or len(w) > 3):
                return False
        return True

    @staticmethod
    def stripped_zh(s: str) -> str:
        change = True
        while change:
            change = False
            for q in QUALIFIERS_ZH:
                if s.startswith(q):
                    s, change = s[len(q) :].strip(), True
                if s.endswith(q):
                    s, change = s[: -len(q)].strip(), True
        return s

    def stripped(self, s: str) -> str:
        words = s.split()
        while len(words) > 1 and words[0] in QUALIFIERS_EN:
            words = words[1:]
        while len(words) > 1 and words[-1] in QUALIFIERS_EN:
            words = words[:-1]
        return self.stripped_zh(" ".join(words))

    def near(self, token: str) -> list[tuple[str, float]]:
        """Tokens of the list that are near, with their share of errors."""
        if (out := self.near_memo.get(token)) is None:
            out = self.tokens.near(token, self.token_errors)
            if len(self.near_memo) < 500_000:
                self.near_memo[token] = out
        return out

    def similar(self, form: str) -> tuple[float, str] | None:
        """(dissimilarity, concept) of the most similar name by its set of tokens."""
        tokens = form.split()
        found = [dict(self.near(t)) for t in tokens]
        own = [max((self.weight[u] for u in f), default=self.unknown) for f in found]
        # Names met only by tokens that together weigh too little cannot be similar enough.
        candidates, rest = set(), sum(own)
        for w, f in sorted(zip(own, found), key=lambda x: -x[0]):
            if rest < self.least_similarity * sum(own):
                break
            candidates.update(i for u in f for i in self.holding[u])
            rest -= w
        best = None
        for i in candidates:
            name, concept = self.sets[i]
            pairs = sorted((e, j, k) for j, f in enumerate(found) for k, u in enumerate(name) if (e := f.get(u)) is not None)
            left, right, both, errors = set(range(len(tokens))), set(range(len(name))), 0.0, 0.0
            for e, j, k in pairs:
                if j in left and k in right:
                    left.discard(j)
                    right.discard(k)
                    both += self.weight[name[k]]
                    errors += e * self.weight[name[k]]
            whole = both + sum(own[j] for j in left) + sum(self.weight[name[k]] for k in right)
            x = (1 - (both - errors) / whole, concept)
            if x[0] <= 1 - self.least_similarity + 1e-9 and (best is None or x < best):
                best = x
        return best

    def as_one(self, form: str) -> tuple[float, str] | None:
        """(share of errors, concept) of the nearest name where spaces do not count."""
        return min(((e, self.concept[n]) for n, e in self.joined.near(form.replace(" ", ""), self.joined_errors)), default=None)

    def __call__(self, value: str) -> str:
        if (out := self.memo.get(value)) is None:
            out = self.mapped(value)
            if len(self.memo) < 500_000:
                self.memo[value] = out
        return out

    def mapped(self, value: str) -> str:
        s = spelling(value)
        if not s:
            return UNMATCHED
        if s in self.names:
            return self.names[s]
        bare = self.stripped(s)
        if bare in self.names:
            return self.names[bare]
        if (code := re.sub(r"\W", "", bare)) in self.codes:
            return self.codes[code]
        if is_code(bare):
            return UNMATCHED
        if found := self.mentions(s):
            rest, at = [], 0
            for a, b, _ in sorted(found):
                rest.append(s[at:a])
                at = b
            if self.says_nothing(" ".join((*rest, s[at:]))):
                return found[0][2]
        forms = {s, bare}
        if "," in (plain := unicodedata.normalize("NFKC", value)):
            head, _, tail = plain.partition(",")
            forms.add(self.stripped(spelling(f"{tail} {head}")))
            forms.add(self.stripped(f"{self.stripped(spelling(tail))} {self.stripped(spelling(head))}"))
        found = [x for f in forms if f for x in (self.similar(f), self.as_one(f)) if x]
        return min(found)[1] if found else UNMATCHED


@lru_cache(4)
def compiled(names: tuple[tuple[str, str], ...]) -> Mapper:
    return Mapper(list(names))


def list_names(concepts: DataFrame, most_names: int = 200_000) -> tuple[tuple[str, str], ...]:
    """(name, concept id) of every canonical name and alias; zh_aliases stand between '|', en_aliases are packed in any way."""
    rows = checked_broadcast_rows(concepts.select("concept_id", "en", "zh", "en_aliases", "zh_aliases").where(F.col("concept_id").isNotNull()), most_names, "the canonical list")
    out = set()
    for r in rows:
        own = [r.en, r.zh, *(x["val"] for x in parse(r.en_aliases)), *(r.zh_aliases or "").split("|")]
        out |= {(n.strip(), r.concept_id) for n in own if n and n.strip(" -—?/.")}
    return tuple(sorted(out))


def mapped(df: DataFrame, id_col: str, text_col: str, concepts: DataFrame) -> DataFrame:
    """(id, concept_id): one row for each id with a non-blank value."""
    names = df.sparkSession.sparkContext.broadcast(list_names(concepts))

    @F.pandas_udf(T.StringType())
    def concept_of(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = compiled(names.value)
        for s in values:
            yield s.map(m)

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("value")).where(F.col("id").isNotNull() & F.col("value").rlike(r"[^\s\p{Z}\p{C}]"))
    return rows.select("id", concept_of("value").alias("concept_id")).groupBy("id").agg(F.min("concept_id").alias("concept_id"))
