from __future__ import annotations

import base64
import hashlib
import html
import json
import random
import re
import time
from pathlib import Path

from bucketwise.llm import chat, decontaminate, license_scan, page_text, secret_scan


def der(tag: int, content: bytes) -> bytes:
    n = len(content)
    size = bytes([n]) if n < 128 else bytes([0x80 | (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8)
    return bytes([tag]) + size + content


NUMBER = lambda n: der(2, b"\x01" + bytes(n))
PKCS1 = der(0x30, NUMBER(0) + b"".join(NUMBER(64) for _ in range(8)))
PKCS8 = der(0x30, der(2, b"\x00") + der(0x30, der(6, b"\x2a\x86\x48\x86") + der(5, b"")) + der(4, bytes(40)))
SEC1 = der(0x30, der(2, b"\x01") + der(4, bytes(32)))


def url64(value: dict) -> str:
    return base64.urlsafe_b64encode(json.dumps(value).encode()).decode().rstrip("=")


def test_structures():
    for key in (PKCS1, PKCS8, SEC1):
        assert secret_scan.is_key(key)
        assert not secret_scan.is_key(key[:-1]) and not secret_scan.is_key(key + b"\x00")
    assert not secret_scan.is_key(der(0x30, der(4, bytes(40)))) and not secret_scan.is_key(b"")
    assert secret_scan.is_token(url64({"alg": "HS256"}) + "." + url64({"sub": 1}) + ".c2ln")
    assert not secret_scan.is_token(url64({"typ": "JWT"}) + "." + url64({"sub": 1}) + ".c2ln")
    assert not secret_scan.is_token(url64({"alg": "HS256"}) + ".bm90anNvbg.c2ln")


def brute_base(text):
    found = [
        (m.start(), m.end(), "assign")
        for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A)
        if len(m[2]) >= 6
    ]
    found += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    rank = ["assign", "access", "hex"]
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(found, key=lambda s: (s[0], rank.index(s[2]))))


def test_secret_scan(spark):
    rng = random.Random(2)
    parts = ["password", "PassWd", "ſecret", "api_key", "APIKEY", "token", "=", ": ", '"', "'", "abc", "abcdef", "AKIA", "AKIAABCDEFGH1234",
             "0123456789abcdef", "deadbeef", " ", "\n", "é", "🙂", "token=token=abcdef", "secret:x"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(200)]
    jwt = url64({"alg": "RS256", "typ": "JWT"}) + "." + url64({"a": 1}) + ".c2lnbmF0dXJl"
    block = "\n".join(base64.encodebytes(PKCS8).decode().split())
    pem = f"-----BEGIN PRIVATE KEY-----\n{block}\n-----END PRIVATE KEY-----"
    special = {
        "jwt": "x " + jwt + " y", "pem": "é" + pem, "der": base64.b64encode(PKCS1).decode(), "der_hex": SEC1.hex(),
        "none": base64.b64encode(b"0" * 90).decode(), "long": "word " * 300_000 + "token=abcdef",
    }
    rows = [(i, t, i % 3, "k") for i, t in enumerate([*texts, *special.values(), None, ""])] + [(None, "token=abcdef", 0, "k")]
    got = secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, n_hex int, kind string")).collect()
    assert len(got) == len(rows)
    by = {r["id"]: r for r in got}
    for i, t in enumerate(texts):
        assert by[i]["base_sha256"] == hashlib.sha256(brute_base(t).encode()).hexdigest(), t
    named = {k: by[len(texts) + i] for i, k in enumerate(special)}
    assert named["jwt"]["n_jwt"] == 1 and f"jwt:2:{2 + len(jwt)}" in named["jwt"]["spans"]
    assert named["pem"]["n_pem"] == 1 and named["pem"]["n_der"] == 0 and named["pem"]["spans"].endswith(f"pem:1:{1 + len(pem)}")
    assert named["der"]["n_der"] == 1 and named["der_hex"]["n_der"] == 1 and named["none"]["n_der"] == 0
    assert named["long"]["spans"] == "assign:1500000:1500012" and by[None]["n_assign"] == 1
    assert by[len(rows) - 2]["spans"] == "" == by[len(rows) - 3]["spans"]


def test_keys_in_other_spellings():
    rng = random.Random(5)
    number = lambda n: der(2, b"\x01" + rng.randbytes(n))
    dsa = der(0x30, der(2, b"\x00") + number(128) + number(20) + number(128) + number(128) + number(20))
    field = lambda b: len(b).to_bytes(4) + b
    ssh = b"openssh-key-v1\x00" + field(b"none") * 2 + field(b"") + (1).to_bytes(4) + field(rng.randbytes(51)) + field(rng.randbytes(136))
    b64 = lambda b: base64.b64encode(b).decode()
    wrap = lambda t, by="\n", n=64: by.join(t[i : i + n] for i in range(0, len(t), n))
    block = lambda body, by="\n": f"-----BEGIN RSA PRIVATE KEY-----{by}{body}{by}-----END RSA PRIVATE KEY-----"
    pem = block(wrap(b64(PKCS1)))
    sealed = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00112233445566778899AABBCCDDEEFF\n\n" + wrap(b64(rng.randbytes(640)))
    jwt = url64({"alg": "RS256"}) + "." + url64({"a": 1}) + ".c2lnbmF0dXJl"
    spans = lambda t: [(k, t[a:b]) for a, b, k in secret_scan.confirmed_spans(t)]
    assert secret_scan.is_key(dsa) and not secret_scan.is_key(dsa[:-1])
    for text, kind, whole in (
        ("PRIVATE_KEY=" + b64(PKCS1), "der", b64(PKCS1)),
        ("key=" + b64(ssh) + "\n", "der", b64(ssh)),
        ("x " + b64(dsa), "der", b64(dsa)),
        ("data: " + b64(pem.encode()), "der", b64(pem.encode())),
        ("hex " + pem.encode().hex(), "der", pem.encode().hex()),
        ("v=" + b64(jwt.encode()), "der", b64(jwt.encode())),
        ("lines\n" + wrap(b64(PKCS1)) + "\nend of it", "der", wrap(b64(PKCS1))),
        (wrap(b64(rng.randbytes(96))) + "\n" + wrap(b64(PKCS1)) + "\nend", "der", wrap(b64(PKCS1))),
        ('{"k": "' + wrap(b64(PKCS8), "\\n", 20 * 2) + '"}', "der", wrap(b64(PKCS8), "\\n", 20 * 2)),
        ('{"k": "' + block(wrap(b64(PKCS8), "\\n"), "\\n") + '\\n"}', "pem", block(wrap(b64(PKCS8), "\\n"), "\\n")),
        ("a " + block(sealed), "pem", block(sealed)),
    ):
        assert spans(text) == [(kind, whole)], text
    for text in (b64(rng.randbytes(900)), wrap(b64(rng.randbytes(900))), "A" * 5000, block("QUJD"), "ab" * 500, "key=" + b64(PKCS1[:-3])):
        assert spans(text) == [], text


def _spans_by_single_decodes(text):
    """The spans of wrapped runs, every start and end decoded by itself."""
    out, done = [], 0
    for m in secret_scan._BASE64.finditer(text):
        if m.start() < done:
            continue
        if m[0][0] in "rnt" and text[m.start() - 1] == "\\":
            m = secret_scan._BASE64.match(text, m.start() + 1) or secret_scan._PART.match(text, m.start() + 1)
        if secret_scan.is_secret(secret_scan.decode64(m[0])):
            out.append(m.span())
            continue
        lines, at = secret_scan._wrapped(text, m), 0
        while len(lines) > 1 and at < len(lines):
            bodies = {n: "".join(text[a:b] for a, b in lines[at:n]) for n in secret_scan._ends(text, lines, at)}
            n = next((n for n, body in bodies.items() if secret_scan.is_secret(secret_scan.decode64(body))), 0)
            if n:
                out.append((lines[at][0], lines[n - 1][1]))
            at = n or at + 1
        done = lines[-1][1] if len(lines) > 1 else 0
    return out


def test_wrapped_blocks_equal_single_decodes():
    rng = random.Random(23)

    def number(n):
        return der(2, bytes([rng.randrange(1, 128)]) + rng.randbytes(n - 1))

    def key():
        return der(0x30, der(2, b"\0") + number(rng.choice([32, 64])) + b"".join(number(20) for _ in range(7)))

    def token():
        parts = [base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=") for x in ({"alg": "HS256"}, {"a": rng.randrange(99)})]
        return ".".join([*parts, "sig"])

    def openssh():
        fields = [b"none", b"none", b"", None, rng.randbytes(50), rng.randbytes(90)]
        return b"openssh-key-v1\0" + b"".join((1).to_bytes(4) if f is None else len(f).to_bytes(4) + f for f in fields)

    def block():
        body = base64.encodebytes(key()).decode()
        return ("-----BEGIN RSA PRIVATE KEY-----\n" + body + "-----END RSA PRIVATE KEY-----\n").encode()

    makers = [key, openssh, block, lambda: token().encode(), lambda: rng.randbytes(rng.randrange(30, 200)), lambda: b"plain text " * rng.randrange(3, 20),
              lambda: b"---x" * rng.randrange(8, 40), lambda: ("\u00e9" + token() + " x").encode()]
    found = 0
    for _ in range(1500):
        width, lines = rng.choice([32, 33, 35, 38, 48, 64]), []
        for _ in range(rng.randrange(1, 5)):
            signs = base64.b64encode(rng.choice(makers)()).decode()
            cut = [signs[i : i + width] for i in range(0, len(signs), width)]
            if rng.random() < 0.7:
                cut[-1] = (cut[-1].rstrip("=") + "A" * width)[:width]
            lines += cut
        if rng.random() < 0.3:
            lines.insert(0, (rng.choice(["A", "LS0t", "ZXlK"]) * width)[:width])
        text = "pre " + rng.choice(["\n", "\r\n", "\\n"]).join(lines) + " post"
        want = _spans_by_single_decodes(text)
        assert secret_scan._base64_spans(text) == want, text
        found += len(want)
    assert found > 500


def test_long_blocks_take_linear_time():
    for start in ("LS0t", "ZXlK", "b3BlbnNzaC", "MIIC"):
        for width in (64, 65):
            text = "\n".join((start + "LS0t" * 64)[:width] for _ in range(16_000))
            begun = time.process_time()
            secret_scan.confirmed_spans(text)
            assert time.process_time() - begun < 4, (start, width)


def test_escape_is_reversible_and_leaves_no_control():
    rng = random.Random(4)
    bits = ["<", "|", "\\", "s>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|image|>", "x", "\n", "[", "/"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(12)))
        out = chat.escape(text)
        assert chat.unescape(out) == text
        assert not re.search(r"<\||</?s>|\[/?INST\]|<</?SYS>>", out)


def test_parts_are_flattened_in_order(spark):
    parts = [
        {"type": "text", "text": "<"}, {"type": "text", "text": "|image|> look"}, {"type": "image", "ref": "a.png", "width": 57, "height": 28},
        {"type": "audio", "ref": "b.wav", "seconds": 2.0}, {"type": "text", "text": "end\\"}, {"type": "scan", "ref": "c", "pages": 3}, None,
    ]
    names = ("type", "text", "ref", "width", "height", "seconds", "pages")
    full = [None if p is None else tuple(p.get(n) for n in names) for p in parts]
    rows = spark.createDataFrame([(1, 0, "assistant", full)], f"c long, t int, role string, parts array<{chat.PART}>")
    turns = chat.format_turns(rows, rows["c"], rows["t"], rows["role"], rows["parts"])
    got = turns.first()
    assert got["formatted"] == "<|turn|>assistant\n<\\|image|> look<|image|><|audio|>end\\\\<|document|></s>"
    assert [(a["type"], a["ref"], a["tokens"]) for a in got["attachments"]] == [("image", "a.png", 3), ("audio", "b.wav", 50), ("document", "c", 3072)]
    role, text, body = chat.read_turn(got["formatted"])
    assert (role, text) == ("assistant", "<|image|> lookend\\")
    assert got["formatted"][got["body_start"] : got["body_start"] + got["body_length"]] == body
    assert chat.conversation_digests(turns).first()["attachment_tokens"] == 3125


def test_conversation_digests(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "us\ner\\", "</s>[INST] \\"), (1, 1, "assistant", "a"), (2, None, None, None), (None, 0, "user", "x"),
            (1, 1, "assistant", "a")]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    turns = chat.format_turns(frame, frame["conv_id"], frame["turn"], frame["role"], chat.text_part(frame["text"]))
    got = {r["conv"]: r for r in chat.conversation_digests(turns).collect()}
    want = "us\ner\\\n</s>[INST] \\\n" + "assistant\na\n" * 2 + "assistant\nb\n"
    assert got[1]["turns_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    assert (got[1]["n_turns"], got[1]["loss_chars"], got[1]["loss_sha256"]) == (4, 3, hashlib.sha256(b"aab").hexdigest())
    assert got[2]["turns_sha256"] == hashlib.sha256(b"\n\n").hexdigest() and got[None]["n_turns"] == 1
    assert got[2]["loss_sha256"] == hashlib.sha256(b"").hexdigest()
    empty = chat.format_turns(frame.limit(0), frame["conv_id"], frame["turn"], frame["role"], chat.text_part(frame["text"]))
    assert chat.conversation_digests(empty).count() == 0


def test_pages():
    article = "<h1>Ti&amp;tle</h1><p><b>Bo<i>ld</i></b> one<br>two&nbsp;three<p>short</p><ul><li>item</li></ul>"
    want = "Ti&tle Bold one two three short item"
    for page in (
        f"<nav><a href=x>Menu</a></nav><article>{article}</article><footer>f</footer>",
        f"<body><header>Site<nav>m</nav></header><main>{article}<div class='user-comments'>{'nice ' * 400}</div></main>",
        f"<div class='ad'>Buy<p>now<article>{article}</article>",
        f"<script>var a='<p>x</p>';</script><style>p{{}}</style>{article}<aside>side</aside><form>in <input></form>",
        f"<div id=cookie-notice>c</div><div class=content>{article}</div><div role=contentinfo>i</div><!-- <p>no</p> -->",
        f"<ARTICLE>{article}<footer>by</footer></ARTICLE><p hidden>h</p></div></p>",
        f"<div id=header>Site</div><div class='entry-header'></div><div>{article}<ol class=commentlist><li>nice</ol></div><div class='site-notice'>n</div>",
        f"<header><a href=/>Home</a></header><article><header>{article}</header><section id=comments><p>{'so true ' * 90}</p></section></article>",
    ):
        assert page_text.main_text(page) == want, page
    assert page_text.main_text("") == page_text.main_text("<nav>x</nav><script>y") == ""
    assert page_text.main_text("plain &lt;words&gt;") == "plain <words>"
    long = "<article>" + "<p>" + "word " * 200_000 + "</p><p>x</p></article>"
    assert page_text.main_text(long) == "word " * 200_000 + "x"


def test_pages_with_other_shapes():
    story = [f"Paragraph {i} of the story goes on for quite a while, as stories do, and then it ends." for i in range(12)]
    body = "".join(f"<p>{x}</p>" for x in story)
    teaser = "<article><h2>Teaser</h2><p>Read more</p><p>short.</p></article>"
    for page in (f"<div>{body}</div>{teaser}", f"{teaser}<div>{body}</div>", f"<main>{body}</main><aside>{teaser}</aside>"):
        assert page_text.main_text(page) == " ".join(story), page
    lines = [str(i) + "x" * 40 + " " + "y" * 56 for i in range(10)]
    last = "long " * 999 + "end"
    assert page_text.main_text("".join(f"<div>{x}</div>" for x in lines) + f"<div>{last}</div>") == " ".join([*lines, last])
    price = "The price of one share rose by four in a hundred on Monday."
    for markup in (f"<div class='share-price widget'><p>{price}</p></div>", f"<p class='share-price widget'>{price}</p>"):
        page = f"<article><p>{story[0]}</p>{markup}<div class='social-share'><p>Share this:</p><a href=x>Mail</a></div><p>{story[1]}</p></article>"
        assert page_text.main_text(page) == f"{story[0]} {price} {story[1]}"
    assert page_text.main_text("<p>a &#x41;&#65;&#0000000000066; b" + "&#" + "9" * 5000 + ";</p>") == "a AAB b\ufffd"
    assert page_text.main_text("<p title='1 > 0'>a</p><p title='>b</p><p>c</p>") == "a b c"


def _random_page(rng):
    """A page of random parts and the text of its article."""
    def sentence(n):
        return " ".join(rng.choice(["stone", "river", "caf\u00e9", "light", "a&b", "x<y", "many", "old"]) for _ in range(n)) + "."

    def mark(text):
        words = [html.escape(w) for w in text.split()]
        k = rng.randrange(len(words))
        words[k] = rng.choice(["<b>{}</b>", "<i><em>{}</em></i>", "<span class=x>{}</span>", "{}", "{}<!-- <p>no</p> -->"]).format(words[k])
        return rng.choice([" ", "\n  ", "\t"]).join(words)

    def furniture():
        text = html.escape(sentence(rng.randrange(1, 60)))
        return rng.choice([
            "<nav><ul><li><a href='/'>{}</a></li></ul></nav>", "<footer><p>{}</p></footer>", "<aside><div><p>{}</p></div></aside>",
            "<div class='ad-slot'><p>{}</p></div>", "<section id=comments><p>{}</p><p>nice</p></section>", "<form><p>{}</p><input></form>",
            "<script>var a = '<p>{}</p>';</script>", "<style>p {{}} /* {} */</style>", "<div class=\"cookie notice\"><p>{}</p></div>",
            "<div hidden><p>{}</p></div>", "<div role='navigation'>{}</div>",
        ]).format(text)

    blocks = [sentence(rng.randrange(8, 40)) for _ in range(rng.randrange(1, 12))]
    tags = [rng.choice(["p", "p", "h2", "blockquote", "li"]) for _ in blocks]
    inner = "".join(f"<{t}>{mark(b)}</{t}>" + (furniture() if rng.random() < 0.2 else "") for t, b in zip(tags, blocks))
    holder = rng.choice(["<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", "<div class=content>{}</div>"])
    before, after = ("".join(furniture() for _ in range(rng.randrange(4))) for _ in range(2))
    return f"<html><head><title>T</title></head><body>{before}{holder.format(inner)}{after}</body></html>", " ".join(blocks)


def test_random_pages_give_their_articles(spark):
    rng = random.Random(5)
    pages = [_random_page(rng) for _ in range(400)]
    frame = spark.createDataFrame([(i, "u", page) for i, (page, _) in enumerate(pages)], "page_id long, url string, html string")
    got = {r["id"]: (r["text"], r["n_chars"]) for r in page_text.extract(frame).collect()}
    for i, (page, want) in enumerate(pages):
        assert got[i] == (want, len(want)), page


def test_walk_agrees_with_a_plain_stack():
    """Kinds of furniture, homes and blocks by counters and places, against searches through all open elements."""
    rng = random.Random(50)
    names = ["p", "div", "b", "i", "span", "li", "ul", "article", "td", "tr", "table", "h1", "aside"]
    for _ in range(400):
        walk, plain = page_text._Pages(), []
        for _ in range(60):
            name = rng.choice(names)
            inline = name in page_text._INLINE
            if rng.random() < 0.5:
                rest = rng.choice(["", "", " class='ad'", " class=x"])
                page_text._open(walk, name, rest, True)
                targets = page_text._CLOSES.get(name, ())
                for k in range(len(plain) - 1, -1, -1):
                    if plain[k][0] in targets:
                        del plain[k:]
                        break
                    if targets and plain[k][0] in page_text._SCOPES:
                        break
                plain.append((name, name == "aside" or (name != "article" and "'ad'" in rest)))
            else:
                page_text._close(walk, name)
                for k in range(len(plain) - 1, -1, -1):
                    if plain[k][0] == name:
                        plain[k:] = plain[k + 1 :] if inline else []
                        break
                    if inline and plain[k][0] not in page_text._INLINE:
                        break
            assert [e.name for e in walk.stack if not e.gone] == [x for x, _ in plain]
            assert walk.furniture == any(f for _, f in plain)
            block = walk.stack[walk.stack[-1].block].name if walk.stack and walk.stack[-1].block >= 0 else None
            assert block == next((x for x, _ in reversed(plain) if x not in page_text._INLINE), None)


def test_long_and_broken_pages_take_linear_time():
    shapes = ["<a ", "<div>x", "<b>x", "<p><b></i>", "<h1><p></p>", "<!", "<head>", "<script", "<a \"'", "<a 'x>", "<p =", "<article>x",
              "<aside><b></b>x", "</b>", "<i class=ad>", "a<aaaa", "<li><i></b>"]
    for shape in shapes:
        for tail in ("", "'>"):
            page = shape * (100_000 // len(shape)) + tail
            start = time.process_time()
            page_text.main_text(page)
            assert time.process_time() - start < 3, (shape, tail)
    start = time.process_time()
    page_text.main_text("<a " * 350_000)
    assert time.process_time() - start < 4


def test_page_rows(spark):
    rows = [(1, "u", "<article><p>a</p></article>", 1), (1, "u", "<article><p>a</p></article>", 1), (None, None, None, 2), (2, "", "", 0)]
    got = page_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert sorted((r["id"] or 0, r["text"], r["n_chars"]) for r in got) == [(0, "", 0), (1, "a", 1), (1, "a", 1), (2, "", 0)]


def test_decontamination(spark):
    rng = random.Random(9)
    words = [f"v{i}" for i in range(5000)]
    item = [rng.choice(words) for _ in range(40)]
    short = ["five", "words", "make", "an", "item"]
    other = [rng.choice(words) for _ in range(60)]
    swapped = [w if i % 9 else "zzz" for i, w in enumerate(item)]
    noise = lambda n: [rng.choice(words) for _ in range(n)]
    docs = {
        1: noise(50) + item + noise(20), 2: noise(9) + swapped + noise(9), 3: noise(300), 4: [w.upper() + "," for w in item],
        5: noise(20) + item[:11] + noise(20), 6: noise(5) + item[:20], 7: short, 8: noise(30) + short + noise(3), 9: short[:4], 10: item[20:] + other,
        11: [w for w in item for _ in (0, 1)], 15: noise(8) + ["one", "two", "three", "four"] + noise(8), 16: noise(8) + ["one", "two", "three"],
    }
    rows = [(i, " ".join(w), "x", 1) for i, w in docs.items()] + [(12, None, "x", 1), (13, "", "x", 1), (None, " ".join(item), "x", 1), (1, " ".join(docs[1]), "x", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, item string, size int")
    items = spark.createDataFrame(
        [(100, " ".join(item), "e"), (101, " ".join(short), "e"), (102, "one two three four", "e"), (103, None, "e"), (105, " ", "e"), (104, " ".join(other), "e"), (104, " ".join(other), "e")],
        "item_id long, text string, seed string",
    )
    got = decontaminate.leaks(frame, items).collect()
    pairs = sorted((r["id"] or 0, r["item"]) for r in got)
    assert pairs == [(0, 100), (1, 100), (1, 100), (2, 100), (4, 100), (6, 100), (7, 101), (8, 101), (9, 101), (10, 100), (10, 104), (15, 102)]
    first = next(r for r in got if r["id"] == 1)
    assert (first["overlap_tokens"], first["item_tokens"], first["start_token"]) == (40, 40, 50)
    clean = decontaminate.drop_leaks(frame, items)
    assert clean.columns == frame.columns
    assert sorted(r["doc_id"] for r in clean.collect()) == [3, 5, 11, 12, 13, 16]
    assert decontaminate.leaks(frame, items.limit(0)).count() == 0 == decontaminate.leaks(frame.limit(0), items).count()


def test_mask_families_are_spaced_and_lossless():
    rng = random.Random(21)
    for n in [*range(1, 18), 24, 40]:
        masks, least = decontaminate.masks_of(n), min(decontaminate.needed(n), 13)
        assert n < 3 or all("0" in m for m in masks)
        assert all(m[0] == m[-1] == "1" for m in masks) and len(masks) <= decontaminate.FAMILY
        longest = n if least < 13 else 32
        for size, sets in decontaminate.runs(least, longest):
            for m in masks:
                sets = decontaminate.missed(size, sets, m)
            assert not len(sets), (n, size)
        # any run that counts, drawn at random, with plain strings
        for _ in range(300):
            size = rng.randrange(least, max(least, min(n, 60)) + 1)
            bad = {p for p in range(1, size - 1) if rng.random() < rng.choice([0.1, 0.2, 0.3])}
            if size - len(bad) >= least and 5 * (size - len(bad)) >= 4 * size:
                fits = (all(x == "0" or at + i not in bad for i, x in enumerate(m)) for m in masks for at in range(size - len(m) + 1))
                assert any(fits), (n, size, bad)
    assert min(m.count("1") for m in decontaminate.masks_of(40)) == 6


def test_best_run_is_the_best_of_all():
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(300):
        equal = rng.random(rng.integers(1, 30)) < 0.7
        n, a, b = decontaminate.best_run(equal)
        gain = lambda x, y: sum(1 if e else -4 for e in equal[x:y])
        assert gain(a, b) == max(gain(x, y) for x in range(len(equal) + 1) for y in range(x, len(equal) + 1))
        assert n == equal[a:b].sum()


def test_replaced_tokens_at_every_place(spark):
    import itertools

    docs, want = [], set()
    for n in range(1, 21):
        item = [f"i{n}x{k}" for k in range(n)]
        for count in (0, 1, 2):
            for gone in itertools.combinations(range(n), count):
                text = " ".join(["before", "it", *("zzz" if k in gone else w for k, w in enumerate(item)), "after", "it"])
                equal = [k not in gone for k in range(n)]
                most = max((sum(equal[a:b]) for a in range(n) for b in range(a + 1, n + 1) if 5 * sum(equal[a:b]) >= 4 * (b - a)), default=0)
                if most >= min(13, -(-4 * n // 5)):
                    want.add((len(docs), n))
                docs.append((len(docs), text))
    fifth = [f"f{k}" for k in range(30)]
    for shift in range(5):
        want.add((len(docs), 30))
        docs.append((len(docs), " ".join("zzz" if k % 5 == shift else w for k, w in enumerate(fifth))))
    items = [(n, " ".join(f"i{n}x{k}" for k in range(n))) for n in range(1, 21)] + [(30, " ".join(fifth))]
    got = decontaminate.leaks(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    ).collect()
    assert {(r["id"], r["item"]) for r in got} == want and len(got) == len(want) > 1000


def test_run_with_the_most_equal_tokens():
    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(300):
        equal = rng.random(rng.integers(1, 30)) < 0.7
        n, a, b = decontaminate.most_equal(equal)
        size = len(equal)
        fits = [equal[x:y].sum() for x in range(size) for y in range(x + 1, size + 1) if 5 * equal[x:y].sum() >= 4 * (y - x)]
        assert n == max(fits, default=0) == equal[a:b].sum() and (n == 0 or 5 * n >= 4 * (b - a))


def test_licenses(spark):
    mit = next(t for n, k, t in license_scan.KNOWN if (n, k) == ("MIT", "text"))
    variant = mit.replace("MIT License\n", "  mit   LICENCE\nCopyright (c) 2020 A. Person\nAll rights reserved.\n").replace("sublicense", "sub-license").replace('"', "“")
    rows = [
        (1, mit, "x"), (2, variant, "x"), (3, mit + " extra", "x"), (4, "text\nlicensed under the APACHE licence; version 2.0\nmore\nLicensed under the Apache License, Version 2.0.", "x"),
        (5, None, "x"), (6, "", "x"), (6, "", "x"), (None, "SPDX-License-Identifier: MIT", "x"), (7, "a\n" * 50_000 + "SPDX-License-Identifier: MIT", "x"),
    ]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, license string")).collect()
    assert len(got) == len(rows)
    by = {r["id"]: r for r in got}
    assert by[1]["text_license"] == by[2]["text_license"] == "MIT" and by[1]["canonical_sha256"] == by[2]["canonical_sha256"]
    assert by[3]["text_license"] is None and by[3]["licenses"] == ""
    assert (by[4]["n_notices"], by[4]["licenses"]) == (2, "Apache-2.0")
    assert (by[None]["text_license"], by[None]["licenses"], by[7]["licenses"], by[7]["text_license"]) == ("MIT", "MIT", "MIT", None)
    assert by[6]["licenses"] == "" and by[5]["n_notices"] == 0
    assert license_scan.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_licenses_are_covered(spark):
    folder = Path(license_scan.__file__).parent / "licenses"
    texts = {p.stem: p.read_text(encoding="utf-8") for p in folder.glob("*.txt")}
    assert {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense", "CC0-1.0"} <= set(texts)
    lines = {
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License": "CC-BY-ND-4.0",
        "Released under the GPL v3": "GPL-3.0", "SPDX-License-Identifier: LGPL-2.1-or-later": "LGPL-2.1", "Distributed under the Boost Software License, Version 1.0.": "BSL-1.0",
        "License: BSD-2-Clause": "BSD-2-Clause",
    }
    names = sorted(texts)
    rows = [(i, "(c) 2020 A. Person\n" + texts[n].replace("\n", " \n  ")) for i, n in enumerate(names)] + [(100 + i, f"words\n{x}\nwords") for i, x in enumerate(lines)]
    got = {r["id"]: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["text_license"] for i in range(len(names))] == names
    assert [got[100 + i]["licenses"] for i in range(len(lines))] == list(lines.values())
