"""Operators over documents against brute force, on invented texts with the cases that break things."""

import base64
import collections
import hashlib
import random
import re

import pytest

from tomeline.llm.decontaminate import contamination, tile
from tomeline.llm.licenses import MISS, TEMPLATES, _classes, bands, least_similarity, licenses, screen
from tomeline.llm.mixing import mix
from tomeline.llm.near_dups import near_duplicates
from tomeline.llm.quality import RULES, Rule, quality
from tomeline.llm.secrets import is_der_key, is_ssh_key, secrets, spans_of
from tomeline.llm.substring_dups import remove_repeats
from tomeline.llm.toxicity import PATTERNS, accuracies, label_model, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
# Extra columns bear names that operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, start int, w string, node long"


def words(text):
    return WORD.findall(text or "")


def invented(seed=5, n=120):
    """(doc_id, text): random texts, exact and near copies, shared passages, odd white space, and the edge cases."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    say = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passage, texts = say(40), []
    for i in range(n):
        kind = i % 8
        if kind in (0, 1) or len(texts) < 4:
            w = say(rng.randint(20, 160))
        elif kind == 2:
            w = list(rng.choice(texts))
        elif kind in (3, 4):
            w = list(rng.choice(texts)) or say(5)
            for _ in range(rng.randint(1, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        elif kind == 5:
            at = rng.randint(0, 20)
            w = say(at) + passage[rng.randint(0, 15) : rng.randint(25, 40)] + say(rng.randint(0, 40))
        elif kind == 6:
            w = say(rng.randint(0, 14))
        else:
            w = say(6) * rng.randint(3, 12)
        texts.append(w)
    rows = [(i, "".join(x + rng.choice([" ", " ", " ", "\n", "\t", "  ", "\x0b", "\r\n"]) for x in w).strip("\r")) for i, w in enumerate(texts)]
    rows += [(n, None), (n + 1, ""), (n + 2, " \n\t "), (n + 3, "Ab cD \u00a0 x\u2028y"), (None, "a text without a name " * 5), (n + 5, " ".join(say(30000))), (3, rows[3][1]), (3, rows[3][1])]
    return rows


def frame(spark, rows, ids="long"):
    full = [(i, t, None if k % 3 else "en", None if k % 5 == 0 else f"s{k % 4}", None, 0.5, True, 1, "x", 7) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, invented()).cache()


def keyed(rows, *names):
    return sorted((tuple(r[n] for n in names) for r in rows), key=repr)


# -- 1 -----------------------------------------------------------------------------------------------


def counted(text):
    text = text or ""
    w = words(text)
    seen = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    again = {j for i in range(len(w) - 2) if seen[w[i], w[i + 1], w[i + 2]] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if words(x)]
    base = len(w) < 50 or 100 * len(again) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again), base


def test_quality_counts(docs):
    got = quality(docs).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert keyed(got, "doc_id", *names) == sorted(((i, *counted(t)) for i, t in invented()), key=repr)
    assert all(not r.kept for r in got if r.base_failed)


def test_quality_rules_reject_whatever_their_order(spark):
    good = " ".join(f"word{i} and" for i in range(60))
    rows = [(1, good), (2, good.replace("and", "a$$d")), (3, good.upper()), (4, good + " lorem ipsum"), (5, "\n".join(["the same line once more here"] * 3 + [good]))]
    for rules in (RULES, RULES[::-1]):
        assert {r.doc_id: r.kept for r in quality(frame(spark, rows), rules).collect()} == {1: True, 2: False, 3: False, 4: False, 5: True}
    assert quality(frame(spark, rows), (Rule("all", "true"),)).filter("kept").count() == 0


# -- 2 -----------------------------------------------------------------------------------------------


def components(rows, k, percent):
    fold = {c: c + 32 for c in range(65, 91)}
    sets = []
    for i, t in rows:
        w = words((t or "").translate(fold))
        sets.append((i, frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])))
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if i is not None and j is not None and i < j and a and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    out = []
    for i, a in sets:
        own = min((j for j, b in sets if b == a and j is not None), default=None) if a else i
        top = find(own) if own is not None else None
        out.append((i, len(a), top, i == top))
    return out


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, k, percent):
    got = near_duplicates(docs, k, percent).collect()
    assert keyed(got, "doc_id", "n_shingles", "component_id", "kept") == sorted(components(invented(), k, percent), key=repr)


def test_near_duplicates_links_the_members_of_large_groups(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(90)]
    rows = []
    for i in range(700):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = near_duplicates(frame(spark, rows), 3, 85).collect()
    assert keyed(got, "doc_id", "n_shingles", "component_id", "kept") == sorted(components(rows, 3, 85), key=repr)


def test_near_duplicates_by_way_of_a_hub_that_is_not_the_first(spark):
    """Variants too far from each other, all near one text in the middle of the ids; more than a block of them."""
    rng = random.Random(23)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(620):
        w = list(base)
        if i != 333:
            for at in rng.sample(range(2, 118), 3):
                w[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = near_duplicates(frame(spark, rows), 3, 85).collect()
    assert keyed(got, "doc_id", "n_shingles", "component_id", "kept") == sorted(components(rows, 3, 85), key=repr)
    assert sum(r.kept for r in got) == 1


def test_near_duplicates_of_named_documents(spark):
    rows = [(None if i is None else f"{i:05}", t) for i, t in invented()[:60]]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id string, text string"), 3, 85).collect()
    assert keyed(got, "doc_id", "n_shingles", "component_id", "kept") == sorted(components(rows, 3, 85), key=repr)


# -- 3 -----------------------------------------------------------------------------------------------

_INNER = bytes([0x02, 0x01, 0x00, 0x30, 0x0D, 0x06, 0x09, *range(1, 10), 0x05, 0x00, 0x04, 0x0E, 0x30, 0x0C, 0x02, 0x0A, *range(1, 11)])
DER = bytes([0x30, len(_INNER)]) + _INNER


def _field(x):
    return len(x).to_bytes(4, "big") + x


def _der(tag, body):
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x80 | (size := (n.bit_length() + 7) // 8)]) + n.to_bytes(size, "big")) + body


PUBLIC = _field(b"ssh-ed25519") + _field(b"k" * 32)
OPENSSH = b"openssh-key-v1\0" + _field(b"none") + _field(b"none") + _field(b"") + (1).to_bytes(4, "big") + _field(PUBLIC) + _field(b"p" * 64)


def test_secret_structures():
    import base64

    assert is_der_key(DER) and not is_der_key(DER[:-1]) and not is_der_key(DER + b"\0") and not is_der_key(b"\x30\x0e" + b"\x41" * 14)
    assert is_ssh_key(PUBLIC) and not is_ssh_key(PUBLIC[:-1])
    assert is_ssh_key(OPENSSH) and not is_ssh_key(OPENSSH[:-1]) and not is_ssh_key(OPENSSH + b"x") and not is_ssh_key(b"openssh-key-v1\0" + b"and then some prose that is no key " * 3)
    deep = _der(0x02, b"\x05" * 9)
    for _ in range(3000):
        deep = _der(0x30, deep)
    assert is_der_key(deep) and not is_der_key(deep[:-1])


def test_escaped_armour_and_signatures():
    """Keys inside JSON strings, whose line ends are escaped; numbers in pairs that are no keys."""
    rng = random.Random(8)
    number = lambda n: b"\x02" + (bytes([n]) if n < 128 else b"\x81" + bytes([n]) if n < 256 else b"\x82" + n.to_bytes(2, "big")) + b"\x01" + bytes(rng.randrange(256) for _ in range(n - 2)) + b"\x01"
    wrap = lambda body: b"\x30" + (bytes([len(body)]) if len(body) < 128 else b"\x82" + len(body).to_bytes(2, "big") if len(body) > 255 else b"\x81" + bytes([len(body)])) + body
    private = wrap(b"\x02\x01\x00" + number(257) + b"\x02\x03\x01\x00\x01" + number(256) + number(129))
    code = base64.b64encode(private).decode()
    lines = [code[i : i + 64] for i in range(0, len(code), 64)]
    for end in ("\\n", "\\r\\n", "\n"):
        armour = f"-----BEGIN PRIVATE KEY-----{end}{end.join(lines)}{end}-----END PRIVATE KEY-----"
        text = f'{{"private_key": "{armour}{end}", "x": 1}}'
        at = text.index("-----BEGIN")
        assert (at, at + len(armour), "pem") in spans_of(text)
        spoilt = text.replace(lines[1], lines[1][:-4])
        assert not any(kind == "pem" for *_, kind in spans_of(spoilt))
    for n in (32, 33, 48, 66):
        signature = wrap(number(n) + number(n))
        assert not is_der_key(signature) and not any(k == "der" for *_, k in spans_of(f"sig {base64.b64encode(signature).decode()} {signature.hex()}"))
    assert is_der_key(wrap(number(257) + b"\x02\x03\x01\x00\x01")) and not is_der_key(wrap(number(257) + b"\x02\x03\x01\x00\x02"))
    head, claims = (base64.urlsafe_b64encode(x).decode().rstrip("=") for x in (b'{"alg":"HS256"}', b'{"sub":"me"}'))
    text = f"é {head}.{claims}.abc and {base64.b64encode(DER).decode()} {DER.hex()} {base64.b64encode(PUBLIC).decode()} eyJub3RoaW5n.x.y M{'A' * 50}"
    assert [k for _, _, k in spans_of(text)] == ["jwt", "der", "hex", "der", "ssh"]
    assert spans_of(text)[0][0] == 2
    assert [k for _, _, k in spans_of(f"{head}.zzz. {head}.{claims}. {head}.zzzz.abc")] == []


def test_secrets_broken_over_lines():
    import base64

    key = _der(0x30, DER * 6 + _der(0x02, bytes(range(200))))
    code = base64.b64encode(key).decode()
    lines = "\n".join(code[i : i + 64] for i in range(0, len(code), 64))
    assert spans_of(f"x {lines}\nwords that follow") == [(2, 2 + len(lines), "der")]
    assert spans_of(f"x {lines[:-9]}\nwords that follow") == []
    url = base64.urlsafe_b64encode(key).decode().rstrip("=")
    assert spans_of(f"({url})") == [(1, 1 + len(url), "der")] and spans_of(f"{url}A .") == []
    clear = f"-----BEGIN RSA PRIVATE KEY-----\n{lines}\n-----END RSA PRIVATE KEY-----"
    closed = f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,{'0A' * 16}\n\n{base64.b64encode(bytes(range(64))).decode()}\n-----END RSA PRIVATE KEY-----"
    assert spans_of(clear) == [(0, len(clear), "pem")] and spans_of(closed) == [(0, len(closed), "pem")]
    assert spans_of(closed.replace("0A" * 16, "0A")) == []


def base_spans(text):
    """The three base kinds by definition, from every place of the text in turn."""
    kinds = {
        "assign": (r"""(?a:(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 1, 12),
        "access": (r"(AKIA[A-Z0-9]+)", 1, 18),
        "hex": (r"([0-9a-f]+)", 1, 16),
    }
    out = []
    for kind, (pattern, group, least) in kinds.items():
        at, fits = 0, re.compile(pattern)
        while at < len(text):
            m = fits.match(text, at)
            if m and len(m[group]) >= least:
                out.append((m.start(), m.end(), kind))
            at = m.end() if m else at + 1
    return sorted(out, key=lambda s: (s[0], list(kinds).index(s[2])))


def test_base_spans_equal_their_definition():
    rng = random.Random(12)
    parts = ["token", "PASSWORD", "Api_Key", "apikey", "secret", ":", "=", " = ", '"', "'", "AKIA", "ABCDEF0123456789XY", "abcdef012345", "deadbeefdeadbeef", "xyz-_./+", " ", "\n", "é", "ſ", "token=abcdefghijklmn"]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 12)))
        assert [s for s in spans_of(text) if s[2] in ("assign", "access", "hex")] == base_spans(text), text


def test_secrets(spark):
    rows = [(1, 'x token = "abcdef0123456789" PassWd:short api_key=ABCDEFGHIJKL token=token:abcdefghijklm'), (2, "AKIA0123456789ABCD AKIA012 ſecret=abcdefghijklmno"), (3, None), (4, ""), (None, "0123456789abcdef" * 2), (1, "nothing")]
    got = {(r.doc_id, r.spans): r for r in secrets(frame(spark, rows), mask="[X]").collect()}
    none = hashlib.sha256(b"").hexdigest()
    assert {(k[0], r.n_assign, r.n_access, r.n_hex) for k, r in got.items()} == {(1, 2, 0, 1), (2, 0, 1, 0), (3, 0, 0, 0), (4, 0, 0, 0), (None, 0, 0, 1), (1, 0, 0, 0)}
    first = next(r for k, r in got.items() if k[0] == 1 and k[1])
    assert first.spans == "assign:2:27,hex:11:27,assign:42:62"
    assert first.base_sha256 == hashlib.sha256(first.spans.encode()).hexdigest() and got[3, ""].base_sha256 == none
    assert first.masked == 'x [X]" PassWd:short [X] token=token:abcdefghijklm'
    assert got[3, ""].masked is None and got[4, ""].masked == "" and got[None, "hex:0:32"].masked == "[X]"


# -- 4 -----------------------------------------------------------------------------------------------


def removed(rows, length=13):
    owner = {}
    for i, t in rows:
        w = words(t)
        for j in range(len(w) - length + 1):
            if i is not None:
                key = tuple(w[j : j + length])
                owner[key] = min(i, owner.get(key, i))
    out = []
    for i, t in rows:
        w = words(t)
        gone = {x for j in range(len(w) - length + 1) if i is not None and owner[tuple(w[j : j + length])] < i for x in range(j, j + length)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_remove_repeats(docs):
    got = remove_repeats(docs, with_text=True).collect()
    assert keyed(got, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(removed(invented()), key=repr)
    assert sum(r.n_removed for r in got) > 500
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got if r.kept_text is not None)


def test_remove_repeats_of_passages_within_passages(spark):
    """Overlapping passages of several documents, repeats within one, periodic texts: all that an owner's match does not explain."""
    rng = random.Random(21)
    say = lambda n, k=9: [f"v{rng.randrange(k)}" for _ in range(n)]
    base, rows = say(60, 500), []
    for i in range(160):
        w = []
        for _ in range(rng.randint(1, 4)):
            kind = rng.randrange(5)
            at = rng.randrange(45)
            w += say(rng.randint(0, 9), 500) if kind == 0 else base[at : at + rng.randint(5, 40)] if kind < 3 else ["x", "y"] * rng.randint(3, 12) if kind == 3 else say(rng.randint(8, 20), 2)
        rows.append((i % 150 if i % 40 else None, " ".join(w)))
    got = remove_repeats(frame(spark, rows)).collect()
    assert keyed(got, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(removed(rows), key=repr)
    named = [(None if i is None else f"{i:04}", t) for i, t in rows]
    got = remove_repeats(spark.createDataFrame(named, "doc_id string, text string")).collect()
    assert keyed(got, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(removed(named), key=repr)


# -- 5 -----------------------------------------------------------------------------------------------


def test_licenses(spark):
    rng = random.Random(4)
    noise = lambda n: " ".join(f"n{rng.randrange(999)}" for _ in range(n))
    rows = [(i, f"{noise(i * 7)} {text.upper() if i % 2 else text}\n{noise(9)}") for i, (_, text) in enumerate(TEMPLATES)]
    long = TEMPLATES[5][1].split()
    rows += [(100, " ".join(long[:-1])), (101, " ".join(x for i, x in enumerate(long) if i % 4)), (102, None), (103, ""), (None, TEMPLATES[3][1]), (104, noise(50) + " the license of software"), (0, TEMPLATES[0][1])]
    got = {(r.doc_id, r.license): r for r in licenses(frame(spark, rows)).collect()}
    assert all((i, name) in got for i, (name, _) in enumerate(TEMPLATES))
    assert (100, "mit") in got and (None, "mit") in got and not any(k[0] in (101, 102, 103, 104) for k in got)
    assert got[3, "mit"].containment == 1.0 and got[3, "mit"].first_word <= 21
    whole = {name for name, text in TEMPLATES if len(text.split()) > 150}
    assert whole == {"mit", "bsd-2-clause", "bsd-3-clause"}


def test_licenses_equal_plain_containment(spark):
    """Notices at the start and in the middle of long texts, whole or short of some words: none is lost."""
    split = lambda text: [x for x in re.split("[^a-z0-9]+", text.lower()) if x]
    rng = random.Random(9)
    noise = lambda n: " ".join(f"n{rng.randrange(9999)}" for _ in range(n))
    rows = []
    for i in range(1500):
        name, text = TEMPLATES[(3, 4, 14, i % len(TEMPLATES))[i % 4]]
        before = noise(rng.randrange(5) if i % 3 else rng.randrange(40, 90))
        notice = text.split()
        if i % 5 == 0 and len(notice) > 20:
            notice[-1:] = []
        rows.append((i, f"{before} {' '.join(notice)} {noise(rng.randrange(80, 160))}"))
    want = {}
    for i, text in rows:
        w = split(text)
        have = {tuple(w[j : j + n]) for n in range(1, 6) for j in range(len(w) - n + 1)}
        for name, template in TEMPLATES:
            t = split(template)
            shingles = {tuple(t[j : j + 5]) for j in range(len(t) - 4)} or {tuple(t)}
            share = len(shingles & have) / len(shingles)
            if share * 100 >= 80:
                want[i, name] = max(round(share, 6), want.get((i, name), 0))
    got = {(r.doc_id, r.license): r.containment for r in licenses(frame(spark, rows)).collect()}
    assert len(want) >= len(rows) - 20 and got == want


def test_licenses_of_short_templates(spark):
    short = (("four", "alpha beta gamma delta"), ("three", "one two three"), ("two", "omega psi"), ("one", "sigma"))
    rows = [(i, f"n1 n2 {text} n3 n4 n5") for i, (_, text) in enumerate(short)] + [(9, "alpha beta gamma one two omega")]
    got = {(r.doc_id, r.license, r.first_word, r.containment) for r in licenses(frame(spark, rows), templates=short).collect()}
    assert got == {(i, name, 2, 1.0) for i, (name, _) in enumerate(short)}


def test_license_bands_follow_from_the_least_similar_match():
    for templates in (TEMPLATES, TEMPLATES[:3], (("x", "a b c"),)):
        least = min(least_similarity(templates, c, ids) for c, ids in _classes(templates).items())
        assert least >= 0.3 and (1 - least) ** bands(templates) <= MISS
    # A window by definition: the template's needed shingles, all others foreign.
    c, ids = next((c, ids) for c, ids in _classes(TEMPLATES).items() if c > 100)
    assert all(0.8 * c <= len(re.findall("[a-z0-9]+", TEMPLATES[i][1].lower())) <= c for i in ids)


def test_license_screen_loses_nothing():
    for name, text in TEMPLATES:
        w = [x for x in re.split("[^a-z0-9]+", text.lower()) if x]
        shingles = [w[i : i + 5] for i in range(len(w) - 4)] or [w]
        without = [s for s in shingles if not set(s) & set(screen(TEMPLATES))]
        assert 100 * len(without) < 80 * len(shingles), name


# -- 6 -----------------------------------------------------------------------------------------------


def test_toxicity_is_learnt_from_labels(spark):
    import zlib

    rng = random.Random(8)
    vocabulary = [f"{a}{b}" for a in ("lor", "mip", "dol", "sit", "ame") for b in ("na", "ta", "ri", "so", "ke", "lu", "pe", "vi")]
    rows, labels = [], []
    for i in range(900):
        bad = i % 6 == 0
        w = [rng.choice(vocabulary) for _ in range(60)]
        if bad:
            for _ in range(3):
                w[rng.randrange(60)] = "gruk" + rng.choice(["na", "ta", "ri", "so"]) if i % 12 else rng.choice(["idiot", "moron"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad), "extra"))
    table = spark.createDataFrame([*labels, (None, 1, ""), (5, None, "")], "doc_id long, toxic int, text string")
    got = toxicity(frame(spark, [*rows, (None, None), (2000, "")]), table).collect()
    for r in got:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    known = [r for r in got if r.doc_id is not None and r.doc_id < 900 and r.held_out]
    assert sum(r.predicted == (r.doc_id % 6 == 0) for r in known) >= 0.97 * len(known)


def test_label_model_equals_expectation_maximisation_by_definition():
    """Voters of both signs and a label that errs: posteriors against a plain loop, and against the truth."""
    import math

    import numpy as np

    rng = random.Random(31)
    truth = [int(rng.random() < 0.3) for _ in range(600)]
    speaks = [(0.7, 0.05), (0.5, 0.1), (0.05, 0.6), (0.3, 0.3), (0.4, 0.02)]  # when toxic, when clean
    votes = [[int(rng.random() < s[1 - y]) for s in speaks] for y in truth]
    label = [y if rng.random() < 0.85 else 1 - y for y in truth]
    post = [0.8 if y else 0.2 for y in label]
    for _ in range(10):
        prior = sum(post) / len(post)
        weight = {1: post, 0: [1 - p for p in post]}
        rate = {y: [(sum(w * v[f] for w, v in zip(weight[y], votes, strict=True)) + 0.5) / (sum(weight[y]) + 1) for f in range(5)] for y in (0, 1)}
        own = {y: (sum(w * g for w, g in zip(weight[y], label, strict=True)) + 0.5) / (sum(weight[y]) + 1) for y in (0, 1)}
        new = []
        for v, g in zip(votes, label, strict=True):
            odds = math.log(prior / (1 - prior)) + (math.log(own[1] / own[0]) if g else math.log((1 - own[1]) / (1 - own[0])))
            odds += sum(math.log(rate[1][f] / rate[0][f]) if v[f] else math.log((1 - rate[1][f]) / (1 - rate[0][f])) for f in range(5))
            new.append(1 / (1 + math.exp(-odds)))
        post = new
    got, rates, _ = label_model(np.array(votes), np.array(label), correlated=False)
    assert np.allclose(got, post, atol=1e-9) and np.allclose(rates[1, :5], rate[1]) and np.allclose(rates[:, 5], [own[0], own[1]])
    right = np.mean((got > 0.5) == np.array(truth))
    assert right > 0.9 > np.mean(np.array(label) == np.array(truth))  # better than the label that it was given
    trust = accuracies(np.array(votes), got)
    assert trust[0] > 0.8 and trust[2] > 0.8 and trust[4] > 0.8 and trust[3] < 0.8
    twice = np.column_stack([np.array(votes)[:, :1]] * 4 + [np.array(votes)])
    assert label_model(twice, np.array(label))[2][0] < 0.35  # five equal voters share one vote


def test_patterns_are_of_both_signs():
    import pyarrow as pa
    import pyarrow.compute as pc

    says = lambda text: [i for i, p in enumerate(PATTERNS) if pc.match_substring_regex(pa.array([text]), p)[0].as_py()]
    assert says("You are such an IDIOT") == [0] and says("we will find you") == [1] and says("just shut up") == [2] and says("what the f**k") == [5]
    assert says("Would you mind? Thanks, see also [12].") == [8, 9, 10] and says("a calm text of no kind") == []


def test_toxicity_without_labels_goes_by_the_lexicon(spark):
    rows = [(1, "you pathetic worthless idiot " * 3), (2, "a calm and friendly text"), (3, None)]
    got = {r.doc_id: r.predicted for r in toxicity(frame(spark, rows), spark.createDataFrame([], "doc_id long, toxic int")).collect()}
    assert got == {1: 1, 2: 0, 3: 0}


# -- 9 -----------------------------------------------------------------------------------------------


def tiled(a, b, k):
    """Greedy string tiling by definition; the length of each tile."""
    free_a, free_b, tiles = [True] * len(a), [True] * len(b), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                best = max(best, (n, -j, -i))
        n, j, i = best[0], -best[1], -best[2]
        if n < k:
            return sorted(tiles)
        free_a[i : i + n], free_b[j : j + n] = [False] * n, [False] * n
        tiles.append(n)


def test_tiling_equals_its_definition():
    import numpy as np

    rng = random.Random(1)
    for _ in range(300):
        a, b, k = [rng.randrange(3) for _ in range(rng.randint(0, 25))], [rng.randrange(3) for _ in range(rng.randint(0, 18))], rng.randint(1, 4)
        got = tile(np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64), k, lambda p, q, n, a=a, b=b: a[p : p + n] == b[q : q + n])
        assert sorted(n for *_, n in got) == tiled(a, b, k)
        assert all(a[p : p + n] == b[q : q + n] for p, q, n in got)


def test_tiling_holds_hashes_against_tokens():
    """Of two hashes that are equal by chance no tile is made, and the search goes on below."""
    import numpy as np

    a, b = np.array([1, 2, 3, 4, 5, 6, 9, 1, 2, 3], dtype=np.uint64), np.array([1, 2, 3, 4, 5, 6], dtype=np.uint64)
    assert tile(a, b, 3, lambda p, q, n: n == 3) == [(0, 0, 3), (3, 3, 3)]
    assert tile(a, b, 3, lambda p, q, n: False) == []


def tokens(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())


def covered(rows, items, k=5, percent=50):
    """(doc_id, item_id): best coverage of all pairs, each tiled by definition."""
    out = {}
    for i, text in rows:
        for j, item in items:
            a, b = tokens(text), tokens(item)
            if i is None or j is None or not b:
                continue
            n = sum(tiled(a, b, min(k, len(b))))
            if n * 100 >= len(b) * percent:
                out[i, j] = max(out.get((i, j), 0), round(n / len(b), 6))
    return out


def test_contamination_equals_brute_force(spark):
    rng = random.Random(17)
    phrase = "which of the following is".split()
    say = lambda n: [f"t{rng.randrange(60)}" for _ in range(n)]
    items = [(i, " ".join(phrase + say(rng.randint(0, 14)))) for i in range(25)] + [(40, "one two three"), (41, "x y"), (42, "a a a a a a a a a"), (42, "b b b b c"), (None, "one two three four"), (43, None), (44, "")]
    rows = []
    for i in range(90):
        w = say(rng.randint(0, 12))
        for _ in range(rng.randint(0, 2)):
            own = rng.choice(items)[1] or ""
            own = own.split()
            cut = rng.randint(0, len(own))
            w += (own[cut:] + say(rng.randint(0, 3)) + own[:cut])[: rng.randint(3, 20)]
        rows.append((i % 80, " ".join(w + phrase * rng.randint(0, 2))))
    rows += [(100, "a " * 30), (101, None), (102, ""), (105, "an x, y"), (None, items[0][1]), (103, "One, TWO; three!"), (104, "b b b b"), rows[3]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.coverage for r in contamination(frame(spark, rows), bench).collect()}
    assert got == covered(rows, items) and len(got) > 60
    named = [(None if i is None else f"d{i}", t) for i, t in rows]
    by_name = contamination(spark.createDataFrame(named, "doc_id string, text string"), bench).collect()
    assert {(r.doc_id, r.item_id): r.coverage for r in by_name} == {(f"d{i}", j): c for (i, j), c in got.items()}


def test_contamination_of_long_repetitive_texts(spark):
    rows = [(1, "a " * 300_000), (2, "a b " * 100_000), (3, ("a " * 499 + "z ") * 400)]
    bench = spark.createDataFrame([(1, "a " * 2000), (2, "b a " * 900)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.coverage for r in contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    # Four runs of 499 cover 1996 tokens; the last four are too few for a tile.
    assert got == {(1, 1): 1.0, (2, 2): 1.0, (3, 1): 0.998}


def test_contamination_of_a_dump_of_the_benchmark(spark):
    """One document holds every item, sentences reversed, in more than one row of pairs."""
    rng = random.Random(23)
    items = [(i, [f"t{rng.randrange(10**6)}" for _ in range(40)]) for i in range(1500)]
    dump = " ".join(" ".join(w[20:] + w[:20]) for _, w in items)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    rows = contamination(frame(spark, [(1, dump), (2, " ".join(items[3][1][:25])), (3, "none of it")]), bench).collect()
    assert {(r.doc_id, r.item_id): (r.n_tiled, r.n_tiles) for r in rows} == {(1, i): (40, 2) for i, _ in items} | {(2, 3): (25, 1)}


def test_contamination(spark):
    rng = random.Random(3)
    say = lambda n: [f"t{rng.randrange(10**6)}" for _ in range(n)]
    items = [(i, say(30)) for i in range(6)]
    text = {i: w for i, w in items}
    join = " ".join
    rows = [
        (1, join(say(20) + text[0] + say(9))),
        (2, join(text[1][15:] + say(4) + text[1][:15])),  # rearranged
        (3, join(text[2]).upper().replace(" ", ", ")),
        (4, join(say(30) + text[3][:12] + say(30))),  # too little
        (5, join(say(80))),
        (6, None),
        (None, join(text[0])),
        (1, join(text[0][:20])),
        (7, join(x for i, x in enumerate(text[4]) if i % 4)),  # no five in a row
    ]
    bench = spark.createDataFrame([*((i, join(w), "x") for i, w in items), (10, None, ""), (11, "too short", ""), (None, join(text[5]), "")], "item_id long, text string, seed string")
    got = {(r.doc_id, r.item_id): (r.n_tiled, r.n_tiles, r.coverage) for r in contamination(frame(spark, rows), bench).collect()}
    assert got == {(1, 0): (30, 1, 1.0), (2, 1): (30, 2, 1.0), (3, 2): (30, 1, 1.0)}


# -- 10 ----------------------------------------------------------------------------------------------


def fair_targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        left, share = total - sum(most * sizes[s] for s in capped), sum(weight[s] for s in sizes if s not in capped)
        more = {s for s in sizes if s not in capped and left * weight[s] / share > most * sizes[s]}
        if not more:
            return {s: most * sizes[s] if s in capped else left * weight[s] / share for s in sizes}
        capped |= more


def test_mix(spark):
    rng = random.Random(6)
    rows = []
    for i in range(3000):
        source = rng.choice(["a", "b", "c", "é", None, "big", "big", "big", "big", "big"])
        rows.append((i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 30))) if i % 50 else None, source))
    rows += [(9000, "one two", "small"), (9000, "one two", "small"), (None, "x y z", "a"), (9001, "", "empty")]
    table = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, source string, copies int, target double").repartition(3)
    got = mix(table).collect()
    sizes = collections.defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(words(t))
    want = fair_targets(dict(sizes))
    taken = collections.defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-12) and r.taken == r.copies * r.size and r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    for s in ("a", "b", "c", None, "big"):
        assert taken[s] == pytest.approx(want[s], rel=0.03)
    assert keyed(mix(table.repartition(7)).collect(), "doc_id", "source", "taken") == keyed(got, "doc_id", "source", "taken")


def test_mix_gives_equal_rows_equal_copies(spark):
    """Every id thrice: in one source, and with another text; the draw is the id's own."""
    rows = [(i % 400, " ".join("w" for _ in range(5 + i % 7)), "ab"[i % 400 % 2]) for i in range(1200)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    copies = collections.defaultdict(set)
    got = mix(table, weights=(5, 3)).collect()
    for r in got:
        copies[r.doc_id].add(r.copies)
    assert len(copies) == 400 and all(len(c) == 1 for c in copies.values()) and len({r.copies for r in got}) > 1
    for s in "ab":
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) < 0.03 * mine[0].target


# -- empty tables ------------------------------------------------------------------------------------


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    labels, bench = spark.createDataFrame([], "doc_id long, toxic int"), spark.createDataFrame([], "item_id long, text string")
    for out in (quality(none), near_duplicates(none), secrets(none), remove_repeats(none), licenses(none), toxicity(none, labels), contamination(none, bench), mix(none)):
        assert out.count() == 0
    assert contamination(frame(spark, invented()[:20]), bench).count() == 0
