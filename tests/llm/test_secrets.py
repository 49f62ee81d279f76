import hashlib
import math
import random
import re
import string

from sediment.llm.secrets import CLASSES, Automaton, learn_formats, redact_secrets, scan_secrets, shape

FORMS = [
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]


def by_force(text):
    found = []
    for order, (kind, pattern, group, least) in enumerate(FORMS):
        at = 0
        while (m := pattern.search(text, at)) is not None:
            if len(m[group]) >= least:
                found.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
            at = m.end()
    return [s for _, _, s in sorted(found)]


def rows():
    rng = random.Random(6)
    draw = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    out = [
        None, "", "token", 'password = "hunter22"', "PassWD:abc", "api_key: 'abcdef'", "apikey=abc", "token==abcdef", "ſecret=abcdefgh toKen=abcdefgh", "secret  :  x.y-z_1",
        "token=password=abcdef", "é" * 5 + "token = abcdefgh", "AKIA" + "A" * 15, "AKIA" + "A" * 16, "xAKIAAKIA" + "0" * 30, "a" * 23, "a" * 24, "0" * 100_000,
        "token\n=abcdefgh", "token = \"" + "0123456789abcdef" * 3 + '"', "Secret:abc token:abcdefg secret: longer", "x" * 200_000 + " secret=abcdef",
    ]
    out += [f'word word token = "{draw("0123456789abcdef", 40)}" more' for _ in range(80)]
    out += ["plain " + draw("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", 3) + " " + draw("abcdef ", 60) for _ in range(30)]
    out += [f"bare {draw('0123456789abcdef', 20)} end", f"mixed {draw('0123456789ABCDEFabcdef', 30)}", "some-ordinary-hyphenated-words-2024", "an.address.example.com/path/12"]
    return list(enumerate(out))


def test_base_spans_are_those_of_the_patterns(spark, texts):
    got = {r.doc_id: r for r in scan_secrets(spark, texts(rows())).collect()}
    for i, text in rows():
        want = by_force(text or "")
        base = [s for s in got[i].spans.split(",") if s and not s.startswith("format")]
        assert base == want, text
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(s.startswith(k) for s in want) for k in ("assign", "access", "hex"))


def test_a_learned_format_adds_spans(spark, texts):
    got = {r.doc_id: r for r in scan_secrets(spark, texts(rows())).collect()}
    by_text = {t: got[i] for i, t in rows()}
    bare = next(t for t in by_text if t and t.startswith("bare"))
    assert by_text[bare].spans == "format:5:25" and by_text[bare].format_score > 1.2
    assert by_text["some-ordinary-hyphenated-words-2024"].spans == "" and by_text["an.address.example.com/path/12"].spans == ""


def test_redaction_covers_all_spans(spark, texts):
    docs = texts(rows() + [(None, "token=abcdefgh")])
    got = redact_secrets(spark, docs)
    assert got.columns == docs.columns and got.count() == docs.count()
    found = {r.doc_id: r for r in got.collect()}
    for i, text in rows():
        left = found[i].text
        assert found[i].n_chars == len(left or "") and (not by_force(text or "") or "[secret]" in left)
        if text and not by_force(text) and "bare" not in text:
            assert left == text
    assert found[None].text == "[secret]"


def test_empty_table(spark, texts):
    assert scan_secrets(spark, texts([])).count() == 0 and learn_formats(spark, texts([])) == {}


def test_states_merge_into_loops():
    rng = random.Random(2)
    words = {}
    for _ in range(500):
        w = shape("".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(10, 30))))
        words[w] = words.get(w, 0) + 1
    learned = Automaton(list(words.items()))
    reached, waiting = {0}, [0]
    while waiting:
        for target in learned.next[waiting.pop()].values():
            if target not in reached:
                reached.add(target)
                waiting.append(target)
    assert len(reached) < 100
    assert learned.gain("dh" * 20) > 40 > 0 > learned.gain("l" * 20)
    # the shares of a two-state language: after L always d, after d always L
    other = Automaton([("Ld" * n, 10) for n in range(1, 12)])
    assert other.gain("Ld" * 8) > 0 > other.gain("LL" * 8)


def plain_gain(automaton, word):
    """Bits of a word, state by state, from the merged counts."""
    state, bits = 0, 0.0
    for c in shape(word):
        total = automaton.total[state] + 0.1 * len(CLASSES)
        bits += math.log2((automaton.through[state].get(c, 0) + 0.1) / total) - math.log2(len(CLASSES[c]) / sum(map(len, CLASSES.values())))
        state = automaton.next[state].get(c, 0)
    return bits


def ordinary_bits(word):
    kinds = [string.ascii_lowercase, string.ascii_uppercase, string.digits, "+/_.=-"]
    of = [next(k for k in kinds if c in k) for c in word]
    same = sum(x == y for x, y in zip(word, word[1:]))
    repeated = same * math.log2(68 / 2) + (len(word) - 1 - same) * math.log2(1 / 2)
    chain = math.log2(68 * 0.25 / len(of[0])) + sum(math.log2(68 * (0.85 if x == y else 0.05) / len(y)) for x, y in zip(of, of[1:]))
    return max(0, repeated, chain)


def test_every_candidate_is_scored(spark, texts):
    rng = random.Random(9)
    key = lambda pairs: "".join(f"{rng.choice('ghij')}{rng.choice('klmn')}{rng.randint(10, 99)}" for _ in range(pairs))
    labelled = [f"secret = {key(3)}" for _ in range(40)] + [f'the token: "{key(16)}"' for _ in range(20)]
    short, long = key(3), key(16)
    ordinary = "the ordinary words of a sentence, with (some) numbers 2024 and 12.5 and é a_name or an/other"
    odd = f"é é token=abcdefgh {short}é\n{long}.x {short * 9} token={short}"
    rows = list(enumerate([*labelled, f"bare {short} here", f"bare {long}", ordinary, odd, "x" * 5000, "k" * 70_000 + " " + short, ""]))
    formats = learn_formats(spark, texts(rows))
    shortest = min(a.shortest for a in formats.values())
    assert shortest == 8
    got = {r.doc_id: r for r in scan_secrets(spark, texts(rows)).collect()}
    for i, text in rows:
        base, want, best = by_force(text), [], None
        covered = {k for span in base for k in range(int(span.split(":")[1]), int(span.split(":")[2]))}
        for m in re.finditer(r"[A-Za-z0-9+/_.=-]+", text):
            if len(m[0]) < shortest:
                continue
            bits = max(plain_gain(a, m[0]) for a in formats.values() if len(m[0]) >= a.shortest) - ordinary_bits(m[0])
            best = max(bits / len(m[0]), best if best is not None else -math.inf)
            if bits >= 24 and bits >= 1.2 * len(m[0]) and not covered & set(range(m.start(), m.end())):
                want.append(f"format:{m.start()}:{m.end()}")
        assert [s for s in got[i].spans.split(",") if s.startswith("format")] == want, text[:80]
        assert (got[i].format_score is None) == (best is None) and (best is None or abs(got[i].format_score - best) < 1e-9)
    assert got[60].spans == f"format:5:{5 + len(short)}" and got[61].spans == "format:5:69" and got[62].spans == ""
    clean = {r.doc_id: r.text for r in redact_secrets(spark, texts(rows)).collect()}
    assert clean[60] == "bare [secret] here" and clean[61] == "bare [secret]" and clean[62] == ordinary
    assert short not in clean[63].replace(short * 9, "") and long not in clean[63]


def test_long_labelled_values(spark, texts):
    rng = random.Random(1)
    draw = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = [(i, f"token={draw(n)}") for i, n in enumerate([200_000, 3000, 3000, *[64] * 30])] + [(99, f"bare {draw(64)}x")]
    got = {r.doc_id: r.spans for r in scan_secrets(spark, texts(rows)).collect()}
    assert got[0] == "assign:0:200006,hex:6:200006" and got[99].startswith("hex:5:69")
