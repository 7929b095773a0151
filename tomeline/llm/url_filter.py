"""URL filters by a bit-parallel wildcard automaton.

All glob rules share one bit vector of as many 64-bit words as they need, a bit for each character of
each pattern and one for its start. One Shift-And step moves every pattern at once: states shift by a
place where the character fits, and places before a ``*`` hold their state whatever comes. The steps
run over all URLs of a batch together, character by character.

The rules judge host and path as they stand. The globs judge a canonical form, so that another spelling
of the same address does not pass: percent escapes are decoded until none is left, letters lower-cased,
user names, ports and dots around the host and empty path segments dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stands between host and path, so that a wildcard for subdomains can't reach into the path.
GAP = "\x01"
_HOST = re.compile(r"([^/?#]*)([^?#]*)", re.S)

# The rules of the filter, as (host, path), of which the longest that fits decides.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
# What blocked hosts are called. A name of the first kind counts wherever it stands, one of the second as a whole part between dots and hyphens only.
_ANYWHERE = ("casino", "free-bets", "jackpot", "viagra", "cheap-pills", "spam-farm", "spamfarm", "link-farm", "linkfarm", "ads-track", "adtrack", "doubleclick", "malware")
_WHOLE = ("bet", "bets", "betting", "poker", "slots", "adult", "porn", "xxx", "escort", "escorts", "spam", "warez", "torrent", "torrents", "phish", "phishing", "pills")
# How blocked paths end, or begin.
_ENDINGS = ("/wp-login.php", "/xmlrpc.php", ".exe", ".msi", ".scr", ".bat", ".zip", ".rar", ".7z", ".apk", ".dmg", ".iso", ".torrent")
_BEGINNINGS = ("/cgi-bin/", "/wp-admin/", "/wp-json/")
#: Globs over host (with a dot before and behind it), GAP and path that block what no rule decides.
GLOBS = (
    *(f"*{x}*{GAP}*" for x in _ANYWHERE),
    *(f"*{a}{x}{b}*{GAP}*" for x in _WHOLE for a in ".-" for b in ".-"),
    *(f"*{GAP}*{x}" for x in _ENDINGS),
    *(f"*{GAP}{x}*" for x in _BEGINNINGS),
)


def canonical(host: str, path: str) -> tuple[str, str]:
    """Host and path as globs see them. Every round of decoding shortens the text, so it ends."""

    def decoded(text: str) -> str:
        while (plain := unquote(text, errors="replace")) != text and len(plain) < len(text):
            text = plain
        return "".join(c for c in text.lower() if c > " ")

    host = decoded(host).rsplit("@", 1)[-1]
    return re.sub(r":[0-9]*$", "", host).strip("."), re.sub(r"/(\.?/)+", "/", decoded(path))


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without a ``://``."""
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    host, path = _HOST.match(url, at + 3).groups()
    return re.sub("[A-Z]+", lambda m: m[0].lower(), host), path


class Automaton:
    """All ``patterns`` (``*`` any run, ``?`` any byte) at once over byte strings."""

    def __init__(self, patterns: Sequence[str]):
        places, self.starts, self.ends, at = [], [], [], 0
        for p in patterns:
            state, self_loops, chars = at, [], []
            for c in p.encode():
                if c == ord("*"):
                    self_loops.append(at + len(chars))
                else:
                    chars.append(c)
            places += [(at + i + 1, c) for i, c in enumerate(chars)]
            self.starts.append((state, self_loops))
            at += len(chars) + 1
            self.ends.append(at - 1)
        self.words = max(1, (at + 63) // 64)  # characters beyond ASCII take a place for each of their bytes
        self.fits, self.holds, self.first = np.zeros((256, self.words), np.uint64), np.zeros(self.words, np.uint64), np.zeros(self.words, np.uint64)
        for bit, c in places:
            self.fits[slice(None) if c == ord("?") else c, bit // 64] |= np.uint64(1 << bit % 64)
        for state, loops in self.starts:
            self.first[state // 64] |= np.uint64(1 << state % 64)
            for bit in loops:
                self.holds[bit // 64] |= np.uint64(1 << bit % 64)

    def match(self, texts: Sequence[bytes]) -> np.ndarray:
        """Which patterns (columns) fit the whole of which texts (rows)."""
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        order = np.argsort(-sizes, kind="stable")
        state = np.tile(self.first, (len(texts), 1))
        flat, begins = np.frombuffer(b"".join(texts[i] for i in order) or b"\0", np.uint8), np.concatenate(([0], np.cumsum(sizes[order])[:-1])) if len(texts) else np.zeros(0, np.int64)
        one, top = np.uint64(1), np.uint64(63)
        longest = int(sizes.max(initial=0))
        # How many texts, longest first, have a character at each place.
        alive = np.searchsorted(-sizes[order], -np.arange(longest), side="left")
        for t, live in enumerate(alive.tolist()):
            now = state[:live]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:live] = moved & self.fits[flat[begins[:live] + t]] | now & self.holds
        out = np.zeros((len(texts), len(self.ends)), dtype=bool)
        for p, bit in enumerate(self.ends):
            out[order, p] = (state[:, bit // 64] >> np.uint64(bit % 64) & one).astype(bool)
        return out


#: URLs that one run of the automaton takes; a state is a bit for each character of each pattern.
URLS_AT_ONCE = 4096


def _judge(rules: tuple[tuple[str, str, str], ...], globs: tuple[str, ...]):
    by_length = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    ruling, blocking = Automaton([f"*.{h}{GAP}{p}*" for _, h, p in by_length]), Automaton(globs)
    names, verdicts = np.array([*(h + p for _, h, p in by_length), None], dtype=object), np.array([v for v, _, _ in by_length] + [""], dtype=object)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, URLS_AT_ONCE) for b in batches for i in range(0, b.num_rows, URLS_AT_ONCE)):
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            # A dot before the host lets a rule fit the host itself as it fits its subdomains.
            hits = ruling.match([f".{h}{GAP}{p.replace(GAP, ' ')}".encode() for h, p in parts])
            n = len(by_length)
            rule = np.where(hits.any(axis=1), hits.argmax(axis=1), n) if n else np.zeros(len(parts), np.int64)
            glob = np.full(len(parts), -1)
            open_ = np.flatnonzero(rule == n)
            if len(open_) and globs:
                bad = blocking.match([f".{h}.{GAP}{p}".encode() for h, p in (canonical(*parts[i]) for i in open_)])
                glob[open_] = np.where(bad.any(axis=1), bad.argmax(axis=1), -1)
            verdict = [verdicts[r] or ("block" if g >= 0 else "allow") for r, g in zip(rule, glob, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()), pa.array(names[rule], pa.string()), pa.array(verdict, pa.string()), pa.array([globs[g].replace(GAP, "|") if g >= 0 else None for g in glob], pa.string())],
                names=["page_id", "host", "path", "rule", "verdict", "glob"],
            )

    return judge


def filter_urls(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, globs: tuple[str, ...] = GLOBS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row of ``pages``: page_id, host, path, rule, verdict and glob.

    Of the rules whose host is the URL's or a parent domain of it and whose path begins the URL's, the
    longest decides (of equals the first by code point). Otherwise a URL whose canonical form a glob fits
    is blocked, glob naming the first such (with ``|`` between host and path), and all others are allowed.

    A null URL or one without ``://`` has an empty host and path and is allowed. page_id may be null
    and may repeat; rows are judged one by one. Other columns are ignored.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    return rows.mapInArrow(_judge(rules, globs), f"page_id {dict(rows.dtypes)['page_id']}, host string, path string, rule string, verdict string, glob string")
