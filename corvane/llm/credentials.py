"""Problem 2: credentials in source code and prose, found and masked in place.

A secret is a string that is unnatural for the place it stands in.  How natural a string is,
is measured as characters per subword under a public vocabulary (a word of a language
or an identifier costs few subwords, a random string many), and nothing is reported that
does not pass the measure: under ``UNNATURAL`` a string is a candidate anywhere, up to ``STRAINED``
(words glued by digits and symbols, as in passphrases) only where its place says that it is
secret: the value of an assignment, key or header, a default of a lookup, a login in a
URL, the object of a sentence about passwords.  Every literal is measured, also where nothing
names it.  Rules of context then reject placeholders, names of fields, digests, ids,
public keys and rows of data.

Masking replaces every character of the secret by ``*``: offsets, line ends, quotes and
escapes stay, so code still parses and other offsets stay true.

Defined results: null and empty texts hold nothing; of a repeated row one result; of one
id with two contents both count; a text of any length is searched whole; extra columns
are ignored by ``secret_lines``.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
UNNATURAL = 2.6
"""Characters per subword below which a string counts as unnatural (English and identifiers: 3.5 to 6; random: 1.3 to 2.2)."""
STRAINED = 3.8
"""The same in a place that says it holds a secret, for strings with digits or symbols."""
PLAIN = 2.0
"""The same for strings of letters and separators only, which otherwise name a field, a header or a variable."""
RANDOM = 2.0
"""The same for a literal that nothing names and for issued tokens."""


class Secret(NamedTuple):
    start: int
    end: int
    kind: str


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("vocabulary", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=50_000)
def chars_per_subword(text: str, vocabulary: str = VOCABULARY) -> float:
    """How natural a string is."""
    return len(text) / max(1, len(_encoding(vocabulary).encode_ordinary(text)))


# Prefixes of tokens that services hand out, with the least length of what follows.
ISSUED = (
    (r"gh[pousr]_[A-Za-z0-9]{8,}", "token"), (r"github_pat_\w{12,}", "token"), (r"glpat-[\w-]{7,}", "token"), (r"xox[abeoprs]-[\w-]{10,}", "token"),
    (r"(?:AKIA|ASIA)[0-9A-Z]{5,}", "key"), (r"AIza[\w-]{12,}", "key"), (r"sk-(?:proj-|ant-|live-|test-)?[\w-]{12,}", "key"),
    (r"[sr]k_(?:live|test)_\w{10,}", "key"), (r"npm_[A-Za-z0-9]{8,}", "token"), (r"pypi-[\w-]{16,}", "token"), (r"hf_[A-Za-z0-9]{16,}", "token"), (r"dop_v1_[0-9a-f]{16,}", "token"),
    (r"SG\.[\w-]{10,}\.[\w-]{10,}", "key"), (r"ya29\.[\w-]{16,}", "token"), (r"eyJ[\w-]{10,}\.[\w-]{10,}(?:\.[\w-]{8,})?", "token"),
    (r"(?!sha\d|v\d)[a-z]{2,10}_(?:live|test|prod|pat|key|secret)_[A-Za-z0-9]{16,}", "token"), (r"(?!sha\d)[a-z]{3,10}\.[A-Za-z0-9]{10,}\.[A-Za-z0-9_-]{16,}", "token"),
)
_ISSUED = re.compile("|".join(f"(?:{p})" for p, _ in ISSUED))
# Literal beginnings of issued tokens; those that begin with ``_`` or ``.`` stand inside one.
_ISSUED_WORDS = (
    "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xox", "AKIA", "ASIA", "AIza", "sk-", "sk_live_", "sk_test_", "rk_live_", "rk_test_", "npm_", "pypi-", "hf_",
    "dop_v1_", "SG.", "ya29.", "eyJ", "_live_", "_test_", "_prod_", "_pat_", "_key_", "_secret_",
)
_ISSUED_DOTS = re.compile(r"\.(?=[A-Za-z0-9]{10,}\.[A-Za-z0-9_-]{16,})")
_BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----(?P<body>.*?)(?:-----END (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----|\Z)", re.S)
_URL = re.compile(r"://(?P<user>[^\s:/@\"'`<>]*):(?P<value>[^\s@/\"'`]{3,})@(?=[\w\[$.{-])")
_BASIC = re.compile(r"[Bb]asic +(?P<value>[A-Za-z0-9+/]{8,}={0,2})")
_BEARER = re.compile(r"[Bb]earer +(?P<value>[\w.~+/=-]{12,})")
_CURL = re.compile(r"(?:-u|--user)[ =]['\"]?(?P<user>[^\s:'\"]+):(?P<value>[^\s'\"]{4,})")
_CALL = re.compile(r"(?:[lL]og_?[iI]n|[sS]ign_?[iI]n|[aA]uthenticate|[cC]onnect|[cC]redentials?)\s*\(\s*[\"'`][^\"'`\n]+[\"'`]\s*,\s*(?P<q>\\?[\"'`])")

#: Where a name or word about secrets may stand; what follows is matched from there only.
_ANCHOR_WORDS = ("pass", "pwd", "pw", "secret", "token", "key", "auth", "cred", "kennwort", "contrase", "mdp", "haslo", "hasło", "парол")
_TELLING_WORDS = ("log in", "login", "use", "carry", "carries", "call", "sign", "send", "try ")
_CALL_WORDS = ("login", "log_in", "signin", "sign_in", "authenticate", "connect", "credential")
_BEFORE = re.compile(r"[\w$.-]*\Z")
_AFTER = re.compile(r"[\w$.-]*")
_QUOTED = r"(?P<q>\\?[\"'`])"
#: ``= "value"``, ``: "value"``, ``: &str = "value"``, ``"] = "value"`` and the like behind a name.
_ASSIGNED = re.compile(r"\\?[\"'`]?\]?(?:\[\d*\])?\s*[?!]?\s*(?:: *[&'\w\[\]<>., *]+?(?==))?(?::=|=>|=(?!=)|:(?!:))\s*(?:(?:concat!|String::from|SecretStr|Secret|String|bytes|str)\s*)?\(?\s*(?:[a-zA-Z]{0,2}(?=[\"'`\\]))" + _QUOTED)
#: ``NAME", "default")``, ``NAME'] || 'default'`` and the like.
_DEFAULT = re.compile(r"(?:[\"'`]\s*[\])]{0,2}\s*(?:,|\|\||\?\?|\bor\b|\.unwrap_or(?:_else)?\(\s*(?:\|\|\s*)?)|\s*(?:\|\||\?\?))\s*" + _QUOTED)
_PLAIN = re.compile(r"[ \t]*(?:=(?!=)|:(?!:))[ \t]*(?P<value>[^\s\"'`(){}\[\]<>,;]{6,})(?P<after>[ \t]*[;,]?\r?(?:\n|\Z))?")
#: What may stand between a word like "password" and the secret it tells.
_TOLD = re.compile(r"s?(?:[ \t]+(?:is|was|are|now|still|of|for|to|the|set|be|value|here))*[ \t]*[:=]?[ \t]*[`'\"]?(?P<value>[^\s`'\"<>{}()\[\]]{6,})")
_TELLING = re.compile(
    r"\b(?:[lL]og ?in (?:was|is|as|with)[ \t]+`?[\w.@-]+`?[ \t]*(?:/|:|with|and)[ \t]*[`'\"]?|(?:[uU]ses?|[cC]arr(?:y|ies)|[cC]alls? with|[sS]igns? \w+ with|[sS]ends?|[tT]ry (?:it )?with)[ \t]+[`'\"]?)(?P<value>[^\s`'\"<>{}()\[\]]{6,})"
)
_SECRET_TOPIC = re.compile(r"(?i)vault|password|secret|token|bearer|credential|log ?in|api|\bkey\b|sign|until|rotate")

# Words by which a name says that its value is secret.
SECRET_WORDS = frozenset(
    "password passwd pwd passphrase passcode pass pw secret secrets token auth apikey credential credentials cred creds kennwort passwort contrasena contraseña clave haslo motdepasse mdp"
    " passwordkey secretkey authkey accesskey masterkey signingkey privatekey encryptionkey saskey hmackey authtoken accesstoken".split()
)
# Words that make "key" a secret.
KEY_WORDS = frozenset("api access private secret signing sign master encryption encrypt decryption sas auth hmac shared storage account service deploy ssh license app client session jwt cipher crypto root relay subscription admin".split())
# Last words by which a name is about a secret without holding it.
ABOUT_WORDS = frozenset(
    "field label header name names type kind url uri path file dir hash sha sha1 sha256 sha512 md5 digest checksum uuid id ids count length len size max min limit expiry expires ttl regex pattern"
    " hint prompt message error title text placeholder prefix suffix format policy rule rules version column param parameter endpoint host port public pem cert fingerprint index position enabled required".split()
)
_SPLIT = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-zñéł]+|\d+|[^\W\d_a-zA-Z]+")
_PLACEHOLDER = re.compile(
    r"(?i)^(?:<.*>|\[.*\]|\$\{?.*\}?|\{\{?.*\}?\}|%[({]?\w+.*|#\{.*\}|@.*@|\*+|x{4,}|\.{3,}|-+|_+|0+|1+|(?:123456|abcdef)\w*|null|none|nil|undefined|true|false|todo|tbd|n/?a|env:.*"
    r"|(?:your|my|the|insert|put|enter|replace|change|fill|add|use|some|any)[-_. ]?\w*[-_. ]*(?:me|here|token|key|secret|password|pass|this|it|value|api)[\w. -]*"
    r"|(?:example|sample|dummy|fake|test|demo|default|placeholder|redacted|removed|hidden|masked|secret|password|passwd|changeme|letmein|foo|bar|baz|qwerty|user|username|admin|root|guest|pass|pwd|token|key|apikey|value|string)\d{0,4}!?)$"
)
_NUMBERED = re.compile(r"^[A-Za-z]+(?:_[A-Za-z]+)*_?\d{0,2}$")
_IDENTIFIER = re.compile(r"^[A-Za-z_]\w*(?:(?:\.|::|->)[A-Za-z_]\w*)*\(?\)?[;,.]?$")
_HEX = re.compile(r"^(?:sha\d*[-:])?[0-9a-fA-F]{16,}$")
_UUID = re.compile(r"^\{?[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}\}?$")
_DIGEST = re.compile(r"^(?:sha\d+|md5)[-:]")
_WORDY = re.compile(r"^(?=.*\d)[A-Za-z]{2,}+(?:[!@#$%^&*+=.,~?:;_-][A-Za-z]++)*+[!@#$%^&*+=.~?:;-]?(?:\d++[A-Za-z]*+){1,3}$")
_ABOUT_BEFORE = re.compile(r"(?i)\b(?:sha-?\d*|md5|digest|checksum|hash|commit|revision|uuid|guid|integrity|fingerprint|release|version|build|public)\b[\s\w:=`'\"-]{0,24}$")


@lru_cache(maxsize=100_000)
def says_secret(name: str) -> bool:
    """Whether a name is that of a secret rather than of something about one."""
    words = [w.lower() for w in _SPLIT.findall(name)]
    while words and words[-1].isdigit():
        words.pop()
    if not words or words[-1] in ABOUT_WORDS:
        return False
    last = words[-1]
    if last in SECRET_WORDS or last.endswith(("password", "passwd", "secret", "token", "apikey", "kennwort")):
        return True
    if any(w in SECRET_WORDS and w not in ("token", "auth", "pass", "pw") for w in words):
        return True
    if last == "key" and len(words) > 1 and words[-2] in KEY_WORDS:
        return True
    if last.endswith("key") and last[:-3] in KEY_WORDS:
        return True
    return "".join(words[-2:]) in SECRET_WORDS or "".join(words[-3:]) == "motdepasse"


def _mixed(value: str) -> bool:
    """At least two of: digits, capitals within small letters, symbols other than separators."""
    kinds = bool(re.search(r"\d", value)) + bool(re.search(r"[a-z].*[A-Z]|[A-Z].*[a-z]", value)) + bool(re.search(r"[!@#$%^&*+=~?]", value))
    return kinds >= 2 or bool(re.search(r"[a-z]\d+[a-z]+\d", value))


def usable(value: str, named: bool, vocabulary: str = VOCABULARY) -> bool:
    """Whether a literal can be a secret as it stands; ``named``: its place says it is one."""
    value = value.strip()
    if len(value) < 6 or any(c.isspace() for c in value) or _PLACEHOLDER.match(value) or _UUID.match(value) or _DIGEST.match(value):
        return False
    if "${" in value or "{{" in value or "<" in value and ">" in value or "://" in value or len(set(value)) < 4 or value.upper().endswith("EXAMPLE"):
        return False
    if re.search(r"(?i)^(?:your|my)[-_ ]|[-_ ]here$|replace[-_ ]?me|change[-_ ]?me|placeholder|redacted", value):
        return False
    natural = chars_per_subword(value, vocabulary)
    if natural >= (STRAINED if named else UNNATURAL):
        return False
    if _HEX.match(value):
        return named
    if re.match(r"^[./~\\]|^\w+\.(?:\w{1,4})$", value) and not _mixed(value):
        return False
    if named:
        made = re.search(r"\d\W*$|[!@#$%^&*+=~?]|\d.*\d", value) is not None and not _NUMBERED.match(value)
        return natural < (STRAINED if made else PLAIN)
    return _mixed(value)


def _literal(text: str, m: re.Match | None) -> tuple[int, str] | None:
    """(start, value) of the literal whose opening quote ends ``m``: to the same quote on the same line, however far."""
    if m is None:
        return None
    q, start = m.group("q"), m.end("q")
    end = text.find(q, start)
    while end > start and len(q) == 1 and text[end - 1] == "\\" and (end - len(text[start:end].rstrip("\\")) - start) % 2:
        end = text.find(q, end + 1)
    if end < start + 4 or text.find("\n", start, end) >= 0:
        return None
    return start, text[start:end]


_RANDOM_LITERAL = re.compile(r"(?P<q>[\"'`])(?P<value>[A-Za-z0-9_+/.~!@#$%^&*-]{16,}={0,2})(?P=q)")
_CALLED = re.compile(r"[\w\])>]\s*\(\s*(?:[^()\"'`\n]*,\s*)?\Z|(?:=|:=)\s*\Z")
_ABOUT_LINE = re.compile(
    r"(?i)(?:sha-?\d*|md5|digest|checksum|hash|commit|revision|uuid|guid|integrity|fingerprint|nonce|etag|public|pub_?key|cursor|trace|span|\bids?\b|_id\b|[a-z]Id\b|version|seed|salt|alphabet|chars|charset"
    r"|data|blob|base64|b64|png|jpe?g|image|font|wasm|table|expect|assert|example|sample|fixture|regex|pattern)"
)


def _unnamed(text: str, vocabulary: str) -> Iterator[tuple[int, str]]:
    """Random literals that nothing names: an argument or value on a line that doesn't speak of ids, digests or data."""
    for m in _RANDOM_LITERAL.finditer(text):
        value, start = m.group("value"), m.start()
        if not (re.search(r"\d", value) and re.search(r"[a-z]", value) and re.search(r"[A-Z]", value)) or chars_per_subword(value, vocabulary) >= RANDOM:
            continue
        line = text[text.rfind("\n", 0, start) + 1 : start]
        if _CALLED.search(line) and not _ABOUT_LINE.search(line) and not text.startswith((",", "\n\"", "\n'"), m.end()) and usable(value, False, vocabulary):
            yield m.start("value"), value


def _places(text: str, words: tuple[str, ...]) -> list[tuple[int, int]]:
    """Where any of the words occurs (start, end), in order."""
    out = []
    for word in words:
        at = text.find(word)
        while at >= 0:
            out.append((at, at + len(word)))
            at = text.find(word, at + len(word))
    out.sort()
    return out


def find_secrets(text: str, vocabulary: str = VOCABULARY) -> list[Secret]:
    """All secrets of a text, in order, none overlapping another."""
    found: list[Secret] = []
    lower = text.lower()
    if len(lower) != len(text):  # a few letters have a longer small form
        lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)

    def add(start: int, value: str, kind: str) -> None:
        found.append(Secret(start, start + len(value), kind))

    if "-----BEGIN" in text:
        for m in _BLOCK.finditer(text):
            body = re.sub(r"\\[nr]|[\s\"'+,\\.*/#>|-]", "", m.group("body"))
            if len(body) >= 24 and len(set(body)) > 10 and chars_per_subword(body, vocabulary) < UNNATURAL:
                add(m.start(), m.group(), "private key")
    if "://" in text:
        for m in _URL.finditer(text):
            value = m.group("value")
            plain = re.sub(r"%[0-9A-Fa-f]{2}", "x", value)
            if not _PLACEHOLDER.match(value) and "${" not in value and not value.startswith(("$", "{", "<", "%")):
                if chars_per_subword(plain, vocabulary) < (STRAINED if re.search(r"\d|[A-Z]|[!#~._-]", plain) else UNNATURAL):
                    add(m.start("value"), value, "login in a URL")
    if "asic " in text:
        for m in _BASIC.finditer(text):
            try:
                said = base64.b64decode(m.group("value") + "=" * (-len(m.group("value")) % 4), validate=True).decode("utf-8")
            except (binascii.Error, UnicodeDecodeError, ValueError):
                continue
            user, colon, value = said.partition(":")
            if colon and user.isprintable() and value.isprintable() and len(value) >= 3 and not _PLACEHOLDER.match(value) and chars_per_subword(m.group("value"), vocabulary) < UNNATURAL:
                add(m.start("value"), m.group("value"), "login in a header")
    if "earer " in text:
        for m in _BEARER.finditer(text):
            value = m.group("value").rstrip(".")
            if usable(value, False, vocabulary) or _ISSUED.match(value) and chars_per_subword(value, vocabulary) < RANDOM:
                add(m.start("value"), value, "token in a header")
    if "-u" in text:
        for m in _CURL.finditer(text):
            if usable(m.group("value"), True, vocabulary):
                add(m.start("value"), m.group("value"), "login of a command")
    for first in sorted({a for a, _ in _places(text, _ISSUED_WORDS)} | {m.start() for m in _ISSUED_DOTS.finditer(text)}):
        start = first
        if text[start] in "._":
            while start and first - start < 12 and "a" <= text[start - 1] <= "z":
                start -= 1
        if start and (text[start - 1].isalnum() or text[start - 1] in "_/+.=-"):
            continue
        m = _ISSUED.match(text, start)
        if m is None or m.end() < len(text) and (text[m.end()].isalnum() or text[m.end()] == "_"):
            continue
        value = m.group()
        if chars_per_subword(value, vocabulary) >= RANDOM or len(set(value)) < 8 or re.search(r"(?i)example|x{5}|your|placeholder", value) or not re.search(r"\d|[a-z][A-Z]", value):
            continue
        if _ABOUT_BEFORE.search(text[max(0, start - 40) : start]):
            continue
        if "." in value and not value.startswith(("eyJ", "SG.", "ya29.")) and not re.search(r"\d", value):
            continue
        add(start, value, "issued token")
    done = -1
    for first, last in _places(lower, _ANCHOR_WORDS):
        if first < done:
            continue
        start, back = first, 80
        while start > 0 and first - start < back and (text[start - 1].isalnum() or text[start - 1] in "_$.-"):
            start -= 1
            back += start > max(done, 0)
        end = done = _AFTER.match(text, last).end()
        name = text[start:end].rstrip(".-").rsplit(".", 1)[-1]
        if says_secret(name):
            got = _literal(text, _ASSIGNED.match(text, end) or _DEFAULT.match(text, end))
            if got is not None and usable(got[1], True, vocabulary):
                add(*got, "named value")
                continue
            m = _PLAIN.match(text, end)
            if m is not None:
                value = m.group("value").rstrip(".")
                line = text.rfind("\n", 0, start) + 1
                whole = m.group("after") is not None and re.fullmatch(r"[ \t>*#/;-]*(?:export[ \t]+|set[ \t]+)?", text[line:start]) is not None
                if usable(value, True, vocabulary) and (not _IDENTIFIER.match(value) or len(value) >= 16 and re.search(r"\d", value) and chars_per_subword(value, vocabulary) < UNNATURAL - 0.4):
                    if whole or ":" in text[end : m.start("value")] and "-" in text[start:end] or _mixed(value):
                        add(m.start("value"), value, "named value")
                        continue
        if start == first or not (text[start] in "._$" or text[start].isalnum()):
            m = _TOLD.match(text, end)
            if m is not None and _told(text, m, True, vocabulary):
                add(m.start("value"), m.group("value").rstrip(".,;:"), "told in prose")
    if "(" in text:
        for first, _ in _places(lower, _CALL_WORDS):
            got = _literal(text, _CALL.match(text, first))
            if got is not None and usable(got[1], True, vocabulary):
                add(*got, "login of a call")
    for first, _ in _places(lower, _TELLING_WORDS):
        m = _TELLING.match(text, first)
        if m is None:
            continue
        line = text[text.rfind("\n", 0, m.start()) + 1 : (text.find("\n", m.end()) + 1 or len(text) + 1) - 1]
        if _SECRET_TOPIC.search(line.replace(m.group("value"), " ")) and _told(text, m, m.group().lower().startswith(("log", "try")), vocabulary):
            add(m.start("value"), m.group("value").rstrip(".,;:"), "told in prose")
    for start, value in _unnamed(text, vocabulary):
        add(start, value, "random literal")
    # the earliest wins where spans overlap
    out: list[Secret] = []
    for s in sorted(found, key=lambda s: (s.start, -s.end)):
        if not out or s.start >= out[-1].end:
            out.append(s)
    return out


def _told(text: str, m: re.Match, strong: bool, vocabulary: str) -> bool:
    """Whether what stands behind a telling word is a secret; ``strong``: the word is about secrets."""
    value = m.group("value").rstrip(".,;:")
    natural = chars_per_subword(value, vocabulary)
    if natural >= STRAINED:
        return False
    if len(value) < 6 or value[0] in "@-/#*=" or re.search(r"[/\\]|::|->|==|=>|\+=|\(|\$\{", value) or not re.search(r"\d|[!@#$%^&*?]", value):
        return False
    if re.fullmatch(r"[\w.-]+\.(?:py|js|ts|go|rs|java|c|cpp|h|md|json|ya?ml|toml|txt|proto3?|idl|schema|grammar|html?)\W*", value):
        return False
    if re.fullmatch(r"[A-Za-z]+(?:_[A-Za-z0-9]+)*", value):  # an identifier
        return len(value) >= 12 and len(re.findall(r"\d", value)) >= 2 and natural < 2.2
    if _ABOUT_BEFORE.search(text[max(0, m.start("value") - 40) : m.start("value")]):
        return False
    if "=" in value[:-2] and _IDENTIFIER.match(value.split("=")[0]):
        return False
    if len(re.findall(r"\d", value)) >= 2 and len(value) >= 8 and _WORDY.match(value) and (strong or not _IDENTIFIER.match(value)):
        return True
    return usable(value, strong and not _IDENTIFIER.match(value), vocabulary) and natural < UNNATURAL


def mask(text: str, secrets: list[Secret]) -> str:
    """The text with every secret's characters masked; line ends, escapes and the marks of key blocks stay."""
    out, at = [], 0
    for s in secrets:
        out.append(text[at : s.start])
        piece = text[s.start : s.end]
        if s.kind == "private key":
            piece = re.sub(r"(-----(?:BEGIN|END)[A-Z0-9 ]*-----)|(\\[nrt])|[A-Za-z0-9+/=]", lambda m: m.group(1) or m.group(2) or "*", piece)
        else:
            piece = re.sub(r"\\.|[^\r\n]", lambda m: "*" * len(m.group()), piece)
        out.append(piece)
        at = s.end
    out.append(text[at:])
    return "".join(out)


def with_continuations(text: str, secrets: list[Secret]) -> list[Secret]:
    """The secrets together with the further literals of values that are cut into several."""
    out: list[Secret] = []
    following = re.compile(r"[\"'`]\s*(?:\+\s*|\\\s*|\.\s*)?(?P<q>[\"'`])(?P<value>[^\"'`\n\\]+)(?P=q)")
    for s in secrets:
        out.append(s)
        end = s.end
        while s.kind in ("named value", "issued token") and (m := following.match(text, end)) is not None:
            value = m.group("value")
            if re.search(r"\s", value) or text[m.start() : m.start("value")].count(","):
                break
            out.append(Secret(m.start("value"), m.end("value"), s.kind))
            end = m.end("value")
    return [s for k, s in enumerate(out) if not k or s.start >= out[k - 1].end]


def record_texts(chunks: DataFrame, full_chunks: DataFrame) -> DataFrame:
    """Both tables' texts under (origin, record_key), unshuffled."""
    a = full_chunks.select(F.lit("full_chunks").alias("origin"), F.col("chunk_id").alias("record_key"), F.col("content").alias("text"))
    b = chunks.select(F.lit("chunks").alias("origin"), F.col("position").cast("string").alias("record_key"), "text")
    return a.unionByName(b).where("record_key is not null and text is not null and text <> ''")


def secret_lines(chunks: DataFrame, full_chunks: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(origin, record_key, line_no): the lines on which secrets start."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (o, k, n)
                for o, k, t in zip(pdf["origin"], pdf["record_key"], pdf["text"])
                for n in sorted({t.count("\n", 0, s.start) + 1 for s in find_secrets(t, vocabulary)})
            ]
            yield pd.DataFrame(rows, columns=["origin", "record_key", "line_no"])

    return record_texts(chunks, full_chunks).mapInPandas(run, "origin string, record_key string, line_no int").distinct()


def redacted(chunks: DataFrame, full_chunks: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(origin, record_key, text, n_secrets, kinds): the texts that hold secrets, with only these masked."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for o, k, t in zip(pdf["origin"], pdf["record_key"], pdf["text"]):
                s = find_secrets(t, vocabulary)
                if s:
                    rows.append((o, k, mask(t, with_continuations(t, s)), len(s), sorted({x.kind for x in s})))
            yield pd.DataFrame(rows, columns=["origin", "record_key", "text", "n_secrets", "kinds"])

    return record_texts(chunks, full_chunks).mapInPandas(run, "origin string, record_key string, text string, n_secrets int, kinds array<string>").distinct()
