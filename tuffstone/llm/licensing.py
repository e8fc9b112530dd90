"""The license of each code file and repository.

Wording is recognised by templates: license texts and standard headers, and sentences with a place for a
license. An inverted index of rare token shingles of the templates names the candidates at each place of a text;
token sequence alignment confirms them and reports coverage and altered clauses or words. License names are
read by a trie of their spellings, built by rule, into current SPDX ids; ids combined with AND, OR and WITH are
read as expressions. Remarks on other software match no template and state nothing.

Only small columns leave the scan. Statements are folded to the least and greatest license of their
subject, which tells none, one and conflict apart whatever the number of statements.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from itertools import product

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tuffstone.llm.license_texts import EXCEPTIONS, IDS, TEXTS, TITLES, gnu_headers
from tuffstone.runtime import cut, spread

# Spellings of license names, as tokens, and the SPDX id each stands for.
NAMES = {
    "mit": "MIT", "expat": "MIT", "mit x11": "MIT", "mit expat": "MIT",
    "apache 2": "Apache-2.0", "apache 2.0": "Apache-2.0", "apache license 2.0": "Apache-2.0", "apache license version 2.0": "Apache-2.0", "apache software license 2.0": "Apache-2.0", "apache version 2.0": "Apache-2.0", "asl 2.0": "Apache-2.0", "al 2.0": "Apache-2.0", "apache license v 2.0": "Apache-2.0",
    "bsd 3 clause": "BSD-3-Clause", "3 clause bsd": "BSD-3-Clause", "new bsd": "BSD-3-Clause", "modified bsd": "BSD-3-Clause", "revised bsd": "BSD-3-Clause",
    "bsd 2 clause": "BSD-2-Clause", "2 clause bsd": "BSD-2-Clause", "simplified bsd": "BSD-2-Clause", "freebsd": "BSD-2-Clause",
    "isc": "ISC", "zlib": "Zlib", "zlib libpng": "Zlib", "unlicense": "Unlicense",
    "mpl 2.0": "MPL-2.0", "mplv 2.0": "MPL-2.0", "mpl 2": "MPL-2.0", "mplv 2": "MPL-2.0", "mpl v 2.0": "MPL-2.0", "mozilla public license 2.0": "MPL-2.0", "mozilla public license v 2.0": "MPL-2.0", "mozilla public license version 2.0": "MPL-2.0",
    "cc 0": "CC0-1.0", "cc 0 1.0": "CC0-1.0", "cc 0 1.0 universal": "CC0-1.0", "cc 0 1.0 universal dedication": "CC0-1.0", "creative commons zero 1.0": "CC0-1.0", "creative commons zero v 1.0 universal": "CC0-1.0",
    "bsl 1.0": "BSL-1.0", "boost software license 1.0": "BSL-1.0", "boost software license version 1.0": "BSL-1.0", "boost 1.0": "BSL-1.0",
    "epl 2.0": "EPL-2.0", "eplv 2.0": "EPL-2.0", "epl v 2.0": "EPL-2.0", "eclipse public license 2.0": "EPL-2.0", "eclipse public license v 2.0": "EPL-2.0", "eclipse public license version 2.0": "EPL-2.0",
}
# Sentences that state the license of the file they stand in; L is the license.
TEMPLATES = [
    "licensed under the L",
    "licensed under the L the full wording comes with the package",
    "released by its makers under the terms of the L",
    "distributed under the terms of the L",
    "redistribute it and or modify it under the terms of the L",
    "you can hand this file on as the L allows",
    "this file is made available under the L",
    "for this file the rights are those of the L",
    "use changes and copies of this file are governed by the L",
    "use of this source code is governed by the L",
    "you may use this file under either the L as you choose",
    "dual licensed pick the L",
    "terms for this file L",
    "the makers chose L for this file",
    "L applies to everything in this file",
]
# Words that stand for the thing licensed, or another spelling of a word.
SAME_WORD = {"work": "file", "program": "file", "software": "file", "project": "file", "library": "file", "package": "file", "module": "file", "licence": "license", "licenced": "licensed"}

TOKEN = re.compile(r"licenseref-[\w.\-]+|[a-z]+|[0-9]+(?:\.[0-9]+)*|\+|/")
#: Comment signs at the start and the end of lines; every run is taken at once, so long runs stay cheap.
MARKS = re.compile(r"(?m)^[ \t]*(?:/?\*+/?|//+|#+|--+>?|;+|<!--|%+|>+|\"\"\"|''')*|(?<!\*)\*+/[ \t]*\r?$|(?<!-)--+>[ \t]*\r?$")
FIELD = re.compile(r"(?im)^[ \t]*@?(spdx-license-identifier[ \t]*:|licen[sc]e[ \t]*[:\-–][ \t]|licen[sc]e(?=[ \t]+\S)(?<=@license)|_*license_*[ \t]*=[ \t]*|module_license[ \t]*\()[ \t]*[\"'(]*([^\n\r\"';]*)")
HINT = re.compile(r"licen[sc]e|\bterms\b|\brights\b|\bgoverned\b|\bchose\b|\bavailable\b|\bapplies\b|\bhand\b|\bpermission (?:is|to)\b|redistribut|public domain", re.IGNORECASE)


def _gnu() -> Iterator[tuple[str, str]]:
    for letter, word in (("", ""), ("l", "lesser "), ("a", "affero ")):
        short = f"{letter}gpl"
        heads = [short, f"{short}v", f"{short} v", f"{short} version", f"gnu {short}", f"gnu {short} v", f"gnu {short}v", f"gnu {short} version"]
        heads += [f"gnu {word}general public license", f"gnu {word}general public license version", f"gnu {word}general public license v"]
        for number in ("1", "2", "3", "1.0", "2.0", "2.1", "3.0"):
            full = number if "." in number else f"{number}.0"
            for head, (tail, kind) in product(heads, [("", "only"), (" only", "only"), (" +", "or-later"), (" or later", "or-later"), (" or any later version", "or-later"), (" or later version", "or-later"), (" and later", "or-later"), (" or newer", "or-later"), (" or at your option any later version", "or-later"), (" or at your option any later", "or-later")]):
                yield f"{head} {number}{tail}", f"{short.upper()}-{full}-{kind}"


_TRIE: dict = {}
for _name, _id in (*NAMES.items(), *_gnu()):
    _node = _TRIE
    for _token in _name.split():
        _node = _node.setdefault(SAME_WORD.get(_token, _token), {})
    _node[""] = _id


def _words(text: str) -> tuple[str, ...]:
    return tuple(SAME_WORD.get(t, t) for t in TOKEN.findall(text.lower()))


#: Ids that stand for themselves where an id is expected, by their tokens; ids with a number also inside sentences.
_EXACT = {_words(i): i for i in IDS.split()}
_EXCEPTION = {_words(i): i for i in EXCEPTIONS.split()}
for _key, _id in _EXACT.items():
    if len(_key) > 2 and _key[0].isalpha():
        _node = _TRIE
        for _token in _key:
            _node = _node.setdefault(_token, {})
        _node.setdefault("", _id)
_OPERATOR = re.compile(r"(\(|\)|(?<![\w.+-])(?:and|or|with)(?![\w.+-])|/)", re.IGNORECASE)
_FREE_ID = re.compile(r"[A-Za-z][A-Za-z0-9]*(?:-[A-Za-z0-9]+)*-[0-9]+(?:\.[0-9]+)*(?:-[A-Za-z0-9]+)*")


def _single(text: str, tag: bool) -> str | None:
    """The id of one license without operators; None unless all of ``text`` names it."""
    tokens = list(_words(text))
    while tokens and tokens[0] in ("the", "a", "an"):
        tokens.pop(0)
    if tokens and tokens[-1] == "license" and tuple(tokens) not in _EXACT:
        tokens.pop()
    got = _name_at(tokens, 0)
    if got and got[1] == len(tokens):
        return got[0] if not got[0].startswith("licenseref-") else text.strip()
    return _EXACT.get(tuple(tokens)) or (text.strip() if tag and _FREE_ID.fullmatch(text.strip()) else None)


def expression(text: str, tag: bool = True) -> str | None:
    """``text`` as an SPDX expression of current ids, operands in alphabetical order; None if it isn't wholly one.

    AND binds closer than OR, WITH closest. In a ``tag``, ids beyond the table are taken as spelled if they have
    the form of one (name and version).
    """
    parts = [p.strip() for p in _OPERATOR.split(text) if p.strip()]
    at = 0

    def peek() -> str:
        return parts[at].lower() if at < len(parts) else ""

    def choice() -> str | None:
        nonlocal at
        found = []
        while True:
            one = union()
            if one is None:
                return None
            found.append(one)
            if peek() not in ("or", "/"):
                break
            at += 1
        return " OR ".join(sorted({x for f in found for x in f.split(" OR ")}))

    def union() -> str | None:
        nonlocal at
        found = []
        while True:
            one = operand()
            if one is None:
                return None
            found += [one] if " OR " in one else one.split(" AND ")
            if peek() != "and":
                break
            at += 1
        return " AND ".join(sorted(f"({f})" if " OR " in f else f for f in set(found))) if len(set(found)) > 1 else found[0]

    def operand() -> str | None:
        nonlocal at
        if peek() == "(":
            at += 1
            inner = choice()
            if inner is None or peek() != ")":
                return None
            at += 1
            return inner
        if not peek() or peek() in (")", "and", "or", "with", "/"):
            return None
        one = _single(parts[at], tag)
        at += 1
        if one is not None and peek() == "with":
            extra = _EXCEPTION.get(_words(parts[at + 1])) if at + 1 < len(parts) else None
            at += 2
            return f"{one} WITH {extra}" if extra else None
        return one

    got = choice()
    return got if got is not None and at == len(parts) else None


def tokens_of(text: str) -> list[str]:
    return [SAME_WORD.get(t, t) for t in TOKEN.findall(text.lower())]


def _name_at(tokens: list[str], at: int) -> tuple[str, int] | None:
    """The license name that begins at ``at`` and the place behind it, the longest that fits."""
    if at < len(tokens) and tokens[at].startswith("licenseref-"):
        return tokens[at], at + 1
    node, best = _TRIE, None
    for k in range(at, len(tokens)):
        node = node.get(tokens[k])
        if node is None:
            break
        if "" in node:
            best = (node[""], k + 1)
    return best


def license_at(tokens: list[str], at: int) -> tuple[str, int] | None:
    """A license or a choice of licenses beginning at ``at``, as an SPDX expression, and the place behind it."""
    parts: set[str] = set()
    end = at
    while True:
        if end < len(tokens) and tokens[end] in ("the", "a", "an"):
            end += 1
        got = _name_at(tokens, end)
        if got is None:
            break
        parts.add(got[0])
        after = done = got[1]
        if after < len(tokens) and tokens[after] == "license":
            after = done = after + 1
        if after < len(tokens) and tokens[after] in ("or", "/"):
            end = after + 1
            continue
        end = done
        break
    if not parts:
        return None
    return " OR ".join(sorted(parts)), end if end > at else at


def read_license(text: str | None) -> str | None:
    """A license in free spelling as a current SPDX expression; text that is no known license stays as it is."""
    if text is None or not text.strip():
        return None
    return _read(text.strip())


@lru_cache(maxsize=50_000)
def _read(text: str) -> str:
    refs = {r.lower(): r for r in re.findall(r"LicenseRef-[\w.\-]+", text, re.IGNORECASE)}
    whole = expression(text, tag=False)
    if whole is not None:
        return whole
    got = license_at(tokens_of(text), 0)
    return " OR ".join(sorted(refs.get(p, p) for p in got[0].split(" OR "))) if got else text


def _shingles(words: list[str], size: int = 3) -> list[tuple[int, tuple]]:
    return [(i, tuple(words[i : i + size])) for i in range(max(1, len(words) - size + 1))]


class Templates:
    """Templates with an inverted index of their rare shingles."""

    def __init__(self, sentences: list[str] = TEMPLATES, size: int = 3, rare: int = 3, texts: Iterable[tuple[str, str]] = ()):
        self.parts = []
        self.size = size
        index = defaultdict(set)
        for k, s in enumerate(sentences):
            words = [SAME_WORD.get(w, w) for w in s.split()]
            slot = words.index("L".lower()) if "l" in words else words.index("L")
            before = [w for w in words[:slot] if w not in ("the", "a")] if slot else []
            after = words[slot + 1 :]
            self.parts.append((s, before, after))
            for side, seq in ((0, before), (1, after)):
                if (side == 0) == bool(before):
                    for at, sh in _shingles(seq, size):
                        index[sh].add((k, side, at))
        self.index = {sh: sorted(v) for sh, v in index.items() if len({k for k, _, _ in v}) <= rare}
        self.first = {sh[0] for sh in self.index}
        self.passages = Passages([*TEXTS, *gnu_headers(), *texts])
        self.titles = Passages(TITLES, size=3, least=1.0)

    def find(self, tokens: list[str], least: float = 0.8) -> list[tuple[str, str, float, str]]:
        """(template, license, coverage, altered words) of every confirmed template."""
        words = [(i, t) for i, t in enumerate(tokens) if t not in ("the", "a")]
        bare = [t for _, t in words]
        out: dict[int, tuple[str, str, float, str]] = {}
        tried = set()
        for i in [i for i, t in enumerate(bare) if t in self.first]:
            for size in (self.size, 2, 1):
                for k, side, at in self.index.get(tuple(bare[i : i + size]), ()):
                    begin = i - at
                    if (k, begin) in tried:
                        continue
                    tried.add((k, begin))
                    got = self._confirm(k, begin, bare, words, tokens, least)
                    if got and (got[0] not in out or (out[got[0]][2], len(out[got[0]][0])) < (got[1][2], len(got[1][0]))):
                        out[got[0]] = got[1]
        return list(out.values())

    def _confirm(self, k: int, begin: int, bare: list[str], words: list, tokens: list[str], least: float):
        name, before, after = self.parts[k]
        if before:
            best = None
            for shift in (0, 1, -1):
                stop = begin + len(before) + shift
                if 0 < stop < len(bare):
                    got = license_at(tokens, words[stop][0])
                    if got:
                        matched = aligned(before, bare[max(0, begin) : stop])
                        if best is None or len(matched) > len(best[0]):
                            best = (matched, got, words[stop][0])
            if best is None:
                return None
            matched, (license_, end), where = best
            tail = aligned(after, [t for t in tokens[end : end + len(after) + 4]]) if after else set()
            if len(matched) < least * len(before):
                return None
            share = (len(matched) + len(tail)) / (len(before) + len(after))
            altered = [w for j, w in enumerate(before) if j not in matched] + [w for j, w in enumerate(after) if j not in tail]
            return where, (name, license_, share, " ".join(altered))
        stop = words[begin][0] if 0 <= begin < len(words) else -1
        if stop < 0:
            return None
        matched = aligned(after, bare[begin : begin + len(after)])
        if len(matched) < least * len(after):
            return None
        for start in range(max(0, stop - 16), stop):
            got = license_at(tokens, start)
            if got and got[1] == stop:
                return start, (name, got[0], len(matched) / len(after), " ".join(w for j, w in enumerate(after) if j not in matched))
        return None


class Passages:
    """License texts with an inverted index of their rare shingles.

    A shingle is rare if it occurs in at most ``rare`` texts. Texts that share wording differ in how much of the
    place they explain: of those that overlap, the one with the most matched words counts. Numbers tell versions,
    so all of them have to match.
    """

    def __init__(self, texts: Iterable[tuple[str, str]], size: int = 4, rare: int = 8, least: float = 0.9):
        self.least, self.size = least, size
        self.texts = []
        index = defaultdict(list)
        for k, (spdx_id, text) in enumerate(texts):
            clauses = [_words(c) for c in re.split(r"[.;:](?=\s|$)", text)]
            words = [w for c in clauses for w in c]
            self.texts.append((spdx_id, words, [n for n, c in enumerate(clauses) for _ in c]))
            for at in range(len(words) - size + 1):
                index[tuple(words[at : at + size])].append((k, at))
        self.index = {sh: v for sh, v in index.items() if len({k for k, _ in v}) <= rare}
        self.first = {sh[0] for sh in self.index}

    def find(self, tokens: list[str]) -> list[tuple[str, str, float, str, int]]:
        """(template, license, coverage, altered clauses, place) of every confirmed text."""
        votes: Counter = Counter()
        for i in [i for i, t in enumerate(tokens) if t in self.first]:
            for k, at in self.index.get(tuple(tokens[i : i + self.size]), ()):
                votes[k, i - at] += 1
        if not votes:
            return []
        starts: dict[int, list[int]] = defaultdict(list)
        for (k, begin), _ in sorted(votes.items(), key=lambda v: (-v[1], v[0])):
            # A text with words left out or put in votes for places close to each other: they are one place.
            if all(abs(begin - b) > len(self.texts[k][1]) // 4 for b in starts[k]):
                starts[k].append(begin)
        hits = [h for k, begins in starts.items() for b in begins if (h := self._confirm(k, max(0, b), tokens))]
        hits.sort(key=lambda h: (-h[0], -h[5], h[1], h[3]))
        out: list[tuple] = []
        for matched, begin, end, *rest in hits:
            if all(end <= b or begin >= e for b, e, _ in out):
                out.append((begin, end, rest))
        return [(*rest, begin) for begin, _, rest in sorted(out)]

    def _confirm(self, k: int, begin: int, tokens: list[str]):
        spdx_id, words, clause = self.texts[k]
        n = len(words)
        if tokens[begin : begin + n] == words:
            return n, begin, begin + n, f"text of {spdx_id}", spdx_id, 1.0, ""
        low = max(0, begin - n // 4)
        part = tokens[low : begin + n + n // 4 + 8]
        blocks = SequenceMatcher(None, words, part, autojunk=False).get_matching_blocks()
        got = {b.a + j for b in blocks for j in range(b.size)}
        missing = [j for j in range(n) if j not in got]
        if len(got) < self.least * n or any(words[j][0].isdigit() and len(words[j]) > 0 and "version" in words[max(0, j - 2) : j] for j in missing):
            return None
        altered: dict[int, list[str]] = defaultdict(list)
        for j in missing:
            altered[clause[j]].append(words[j])
        said = "; ".join(f"clause {c + 1}: {' '.join(w)}" for c, w in altered.items())
        ends = [b for b in blocks if b.size]
        return len(got), low + ends[0].b, low + ends[-1].b + ends[-1].size, f"text of {spdx_id}", spdx_id, len(got) / n, said


def aligned(template: list[str], text: list[str]) -> set[int]:
    """Places of ``template`` matched in the longest common subsequence with ``text``."""
    n, m = len(template), len(text)
    if template == text:
        return set(range(n))
    rows = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            rows[i][j] = rows[i + 1][j + 1] + 1 if template[i] == text[j] else max(rows[i + 1][j], rows[i][j + 1])
    i = j = 0
    out = set()
    while i < n and j < m:
        if template[i] == text[j]:
            out.add(i)
            i, j = i + 1, j + 1
        elif rows[i + 1][j] >= rows[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def content_statements(content: str | None, is_license_file: bool, templates: Templates) -> list[tuple[str, str, float, str]]:
    """What a text says of its own license: (template, license, coverage, altered words)."""
    if not content or not (is_license_file or HINT.search(content)):
        return []
    refs = {r.lower(): r for r in re.findall(r"LicenseRef-[\w.\-]+", content, re.IGNORECASE)}
    bare = MARKS.sub("", content)
    out = []
    for m in FIELD.finditer(bare):
        field = m[1].strip(" \t:=-(@_").lower()
        tag = field.startswith("spdx")
        whole = expression((bare[m.end(1) : m.end(2)] if tag else m[2]).strip(" \t\"'*/"), tag)
        if whole is not None:
            out.append((field, whole, 1.0, ""))
            continue
        tokens = tokens_of(m[2])
        got = license_at(tokens, 0)
        if got:
            out.append((field, got[0], 1.0, " ".join(tokens[got[1] :])))
    tokens = tokens_of(bare)
    titles = templates.titles.find(tokens[:200]) if is_license_file else []
    # Behind the title of a long text its own wording, examples included, states nothing more.
    out += [t[:4] for t in titles or templates.passages.find(tokens)]
    out += [] if titles else templates.find(tokens)
    if is_license_file and not titles:
        title = next((line for line in bare.splitlines() if line.strip()), "")
        tokens = tokens_of(title)
        got = license_at(tokens, 0)
        if got and got[1] == len(tokens):
            out.append(("title", got[0], 1.0, ""))
    return [(t, " OR ".join(sorted(refs.get(p, p) for p in license_.split(" OR "))), c, a) for t, license_, c, a in out]


def is_license_path(path: Column) -> Column:
    return path.rlike(r"(?i)(?:^|/)(?:licen[sc]e|copying)(?:\.[^/]*)?$")


STATEMENT = "file_id bigint, template string, license string, coverage double, altered string"


def statements(source_files: DataFrame) -> DataFrame:
    """Every statement found in content: ``STATEMENT`` rows. Null and empty content gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates()
        for batch in batches:
            rows = [(i, *s) for i, text, own in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True) for s in content_statements(text, bool(own), templates)]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file_id", "template", "license", "coverage", "altered"])

    return spread(source_files.select("file_id", "content", is_license_path(F.col("path")).alias("own"))).mapInArrow(run, STATEMENT)


def _file_bounds(source_files: DataFrame) -> DataFrame:
    """(file_id, repo_id, path, lo, hi): least and greatest license a file states in content and entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates()
        for batch in batches:
            lo, hi = [], []
            for text, own, entries in zip(*(batch.column(k).to_pylist() for k in ("content", "own", "licenses")), strict=True):
                said = {s[1] for s in content_statements(text, bool(own), templates)}
                said |= {x for x in map(read_license, entries or []) if x}
                lo.append(min(said, default=None))
                hi.append(max(said, default=None))
            yield pa.RecordBatch.from_arrays([batch.column("file_id"), batch.column("repo_id"), batch.column("path"), pa.array(lo, pa.string()), pa.array(hi, pa.string())], ["file_id", "repo_id", "path", "lo", "hi"])

    files = source_files.select("file_id", "repo_id", "path", "content", "licenses", is_license_path(F.col("path")).alias("own"))
    return spread(files).mapInArrow(run, "file_id bigint, repo_id bigint, path string, lo string, hi string")


@F.pandas_udf(StringType())
def spdx(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield part.map(read_license)


def _one(lo: str = "lo", hi: str = "hi") -> Column:
    """None, the one license, or CONFLICT."""
    return F.when(F.col(lo) == F.col(hi), F.col(lo)).when(F.col(lo).isNotNull(), F.lit("CONFLICT"))


def licenses(source_files: DataFrame, findings: DataFrame, components: DataFrame, salts: int = 8) -> DataFrame:
    """``(scope, subject_id, license)``: one row per file that is no license file and one per repository.

    Different statements give CONFLICT. A file without any takes that of the license file in the nearest
    directory at or above its own that states one, else UNKNOWN; a license file whose statements differ
    hands on CONFLICT. A repository takes its root license files and the licenses of its components.
    Null paths count as files at the root that are no license files; files without repository inherit
    nothing. Null and empty wording states nothing; findings count with confidence above 0 only. Repeated
    rows change nothing. File rows are spread over ``salts`` parts of each directory, so one directory may
    hold any share of them.
    """
    found = findings.where("category = 'license' and confidence > 0 and type is not null").select("file_id", spdx("type").alias("lo"))
    found = found.where("lo is not null").groupBy("file_id").agg(F.min("lo").alias("lo"), F.max("lo").alias("hi"))
    # Read by several branches below; without a table of its own each of them would parse all content again.
    known = cut(_file_bounds(source_files)).withColumn("here", F.lit(1))
    both = known.unionByName(found.select("file_id", F.lit(None).cast("bigint").alias("repo_id"), F.lit(None).cast("string").alias("path"), "lo", "hi", F.lit(None).cast("int").alias("here")))
    files = (
        both.groupBy("file_id")
        .agg(F.max("repo_id").alias("repo_id"), F.max("path").alias("path"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("here").alias("here"))
        .where("here = 1")
        .withColumn("path", F.regexp_replace(F.coalesce("path", F.lit("")), r"^(?:\./|/)+", ""))
        .withColumn("dir", F.regexp_replace("path", r"/?[^/]*$", ""))
    )
    own = is_license_path(F.col("path"))
    given = files.where(own & F.col("repo_id").isNotNull() & F.col("lo").isNotNull())
    by_dir = given.groupBy("repo_id", F.col("dir").alias("above")).agg(F.min("lo").alias("dir_lo"), F.max("hi").alias("dir_hi"))
    plain = files.where(~own)
    silent = plain.where("lo is null and repo_id is not null").select("repo_id", "dir").distinct()
    steps = F.split("dir", "/")
    ups = F.when(F.col("dir") == "", F.array(F.struct(F.lit("").alias("above"), F.lit(0).alias("depth")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.struct(F.array_join(F.slice(steps, 1, n), "/").alias("above"), n.alias("depth")))
    )
    climbed = silent.select("repo_id", "dir", F.explode(ups).alias("u")).select("repo_id", "dir", "u.above", "u.depth")
    nearest = climbed.join(by_dir, ["repo_id", "above"]).groupBy("repo_id", "dir").agg(F.max_by(_one("dir_lo", "dir_hi"), "depth").alias("handed"))
    spread = nearest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = plain.withColumn("salt", F.pmod(F.xxhash64("file_id"), F.lit(salts)).cast("int"))
    of_files = salted.join(spread, ["repo_id", "dir", "salt"], "left").select(
        F.lit("file").alias("scope"), F.col("file_id").alias("subject_id"), F.coalesce(_one(), "handed", F.lit("UNKNOWN")).alias("license")
    )
    in_repo = components.where("repo_id is not null and license is not null").groupBy("repo_id", "license").agg(F.count("*").alias("n"))
    in_repo = in_repo.select("repo_id", spdx("license").alias("lo")).select("repo_id", "lo", F.col("lo").alias("hi"), F.lit(None).cast("int").alias("here"))
    rooted = F.when(own & (F.col("dir") == ""), F.col("lo")).alias("lo"), F.when(own & (F.col("dir") == ""), F.col("hi")).alias("hi")
    repos = files.where("repo_id is not null").select("repo_id", *rooted, "here").unionByName(in_repo)
    of_repos = (
        repos.groupBy("repo_id")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("here").alias("here"))
        .where("here = 1")
        .select(F.lit("repo").alias("scope"), F.col("repo_id").alias("subject_id"), F.coalesce(_one(), F.lit("UNKNOWN")).alias("license"))
    )
    return of_files.unionByName(of_repos)
