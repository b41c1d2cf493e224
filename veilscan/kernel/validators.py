"""Checks that decide whether a match is a finding.

A check gets a Context: the matched value and windows of the text around it,
measured in UTF-8 bytes and cut inward to whole characters. Most checks are one
of three shapes and are written as data: a token pattern (``token``), a value
bound to the nearest assignment key (``keyed``), or a structure around the
value. ``CHECKS`` maps a validator's name to (check, priority, confidence,
detection mode).
"""

from __future__ import annotations

import base64
import binascii
import calendar
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

KEY_WINDOW = 160
LAST = 64  # values whose verdict a check remembers: of a text that is edited, the same ones come again

# Words that stand for a secret instead of being one.
PLACEHOLDERS = {b"changeme", b"change_me", b"example", b"example_token", b"example_token_here", b"placeholder", b"redacted", b"secret", b"token", b"your_api_key", b"your_api_key_here", b"your_token", b"your_token_here", b"[redacted]", b"<redacted>", b"***"}
MARKERS = (b"example_token_here", b"your_api_key_here", b"your_token_here", b"placeholder", b"redacted", b"changeme")

_MARKED = re.compile(b"|".join(MARKERS))
_CONTROL = re.compile(r"[\x00-\x1f\x7f-\x9f]")
_QUOTES_AND_SPACE = " \t\n\x0c\r\"'`"
_KEY_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-"


class Context(NamedTuple):
    text: str
    start: int
    end: int

    @property
    def value(self) -> str:
        return self.text[self.start:self.end]

    def before(self, most: int) -> str:
        near = self.text[max(0, self.start - most):self.start]
        if near.isascii():
            return near
        data = near.encode("utf-8", "surrogatepass")[-most:]
        while data and data[0] & 0xC0 == 0x80:
            data = data[1:]
        return data.decode("utf-8", "surrogatepass")

    def after(self, most: int) -> str:
        near = self.text[self.end:self.end + most]
        return near if near.isascii() else near.encode("utf-8", "surrogatepass")[:most].decode("utf-8", "ignore")

    def key(self, most: int = KEY_WINDOW) -> str | None:
        return nearest_key(self.before(most))


Check = Callable[[Context], bool]


def size(value: str) -> int:
    return len(value) if value.isascii() else len(value.encode("utf-8", "surrogatepass"))


def fold(value: str) -> bytes:
    """UTF-8 with A-Z lower-cased, nothing else."""
    return value.encode("utf-8", "surrogatepass").lower()


def controlled(value: str) -> bool:
    return bool(_CONTROL.search(value))


def placeholder(value: str) -> bool:
    v = value.strip()
    low = fold(v)
    if not v or (len(low) >= 3 and v[0] == "<" and v[-1] == ">") or low in PLACEHOLDERS or (len(v) >= 4 and v[0] == v[-1] and v.isascii() and v == v[0] * len(v)):
        return True
    return bool(_MARKED.search(low))


def nearest_key(before: str) -> str | None:
    """The name left of the last = or : of the window, however far back that is."""
    head = before.rstrip(_QUOTES_AND_SPACE)
    at = max(head.rfind("="), head.rfind(":"))
    if at < 0:
        return None
    head = head[:at].rstrip(_QUOTES_AND_SPACE)
    return head[len(head.rstrip(_KEY_CHARS)):] or None


def plain_key(key: str) -> str:
    return key.lower().replace("-", "_").replace(".", "_")


def key_in(key: str | None, names: set[str]) -> bool:
    return key is not None and plain_key(key) in names


def canonical_base64(value: str, most: int) -> bytes | None:
    if not (value.isascii() and 4 <= len(value) <= most):
        return None
    try:
        data = base64.b64decode(value, validate=True)
    except (binascii.Error, ValueError):
        return None
    return data if base64.b64encode(data).decode() == value else None


# --- shapes of checks


def token(pattern: str, most: int | None = 255, refused: Callable[[str], bool] = placeholder) -> Check:
    """The whole ASCII value matches; neither it nor its group ``p`` is a placeholder."""
    rx = re.compile(pattern, re.A)

    @lru_cache(LAST)
    def sound(v: str) -> bool:
        if not v.isascii() or (most is not None and len(v) > most) or placeholder(v):
            return False
        m = rx.fullmatch(v)
        return bool(m) and not ("p" in rx.groupindex and m["p"] is not None and refused(m["p"]))

    return lambda c: sound(c.text[c.start:c.end])


def keyed(*cases: tuple[set[str], str], ascii_only: bool = True, control_free: bool = False, sizes: tuple[int, int] = (1, 1 << 30), window: int = KEY_WINDOW) -> Check:
    """Each case: names of the nearest key, and a pattern of the whole value."""
    compiled = [(names, re.compile(pattern, re.S | re.A)) for names, pattern in cases]

    @lru_cache(LAST)
    def sound(v: str, key: str | None) -> bool:
        if (ascii_only and not v.isascii()) or (control_free and controlled(v)) or not sizes[0] <= size(v) <= sizes[1] or placeholder(v):
            return False
        return any(key_in(key, names) and rx.fullmatch(v) for names, rx in compiled)

    return lambda c: sound(c.text[c.start:c.end], c.key(window))


def either(*checks: Check) -> Check:
    return lambda c: any(check(c) for check in checks)


def words(*lists: str) -> set[bytes]:
    return {w.encode() for text in lists for w in text.split()}


# --- tokens with a form of their own

_B64URL = "[A-Za-z0-9_-]+"


def _gitlab_refused(payload: str) -> bool:
    low = fold(payload)
    return placeholder(payload) or low == b"example" or any(m in low for m in (b"token_here", b"your_token", b"test_token", b"placeholder"))


def _tailscale_refused(payload: str) -> bool:
    return placeholder(payload) or fold(payload.strip()) in words("your_key your_key_here example_key example_key_here replace_me replace_me_here")


_jwt_form = token(rf"eyJ[A-Za-z0-9_-]*\.{_B64URL}\.{_B64URL}", 16384)


def jwt(c: Context) -> bool:
    return c.end - c.start >= 32 and _jwt_form(c)


def _crc16(data: bytes) -> int:
    return binascii.crc_hqx(data, 0)  # XMODEM: polynomial 0x1021, start 0


def nats(c: Context) -> bool:
    v = c.value
    if not re.fullmatch("[A-Z2-7]+", v) or placeholder(v) or len(v) not in (58, 108):
        return False
    bits = "".join(f"{'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'.index(ch):05b}" for ch in v)
    whole = len(bits) // 8 * 8
    if "1" in bits[whole:]:
        return False
    raw = int(bits[:whole], 2).to_bytes(whole // 8, "big")
    if int.from_bytes(raw[-2:], "little") != _crc16(raw[:-2]):
        return False
    if len(v) == 108:
        return len(raw) == 67 and raw[0] & 0xF8 == 15 << 3
    public = (raw[0] & 7) << 5 | raw[1] >> 3
    # server, cluster, operator, account, user, curve
    return len(raw) == 36 and raw[0] & 0xF8 == 18 << 3 and public in {13 << 3, 2 << 3, 14 << 3, 0, 20 << 3, 23 << 3}


# Length of an IBAN by its country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28,
    "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23,
    "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28,
    "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28,
    "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24,
    "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}


def iban(c: Context) -> bool:
    if not re.fullmatch("[A-Za-z0-9]+(?: [A-Za-z0-9]+)*", c.value):
        return False
    v = c.value.replace(" ", "")
    if not re.fullmatch("[A-Z]{2}[0-9]{2}[A-Z0-9]+", v) or IBAN_LENGTHS.get(v[:2]) != len(v):
        return False
    return int("".join(str(int(ch, 36)) for ch in v[4:] + v[:4])) % 97 == 1


_OMOCODIA = {ch: i for i, ch in enumerate("LMNPQRSTUV")} | {str(i): i for i in range(10)}
# What a character counts at an odd place (first, third, ...), for 0-9 and then A-Z.
_ODD = dict(zip("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", (1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23)))


def codice_fiscale(c: Context) -> bool:
    v, digit = c.value, "[0-9LMNPQRSTUV]"
    if not re.fullmatch(rf"[A-Z]{{6}}{digit}{{2}}[ABCDEHLMPRST]{digit}{{2}}[A-Z]{digit}{{3}}[A-Z]", v):
        return False
    day = _OMOCODIA[v[9]] * 10 + _OMOCODIA[v[10]]
    if not (1 <= day <= 31 or 41 <= day <= 71):
        return False
    total = sum(_ODD[ch] if i % 2 == 0 else int(ch, 36) - (0 if ch.isdigit() else 10) for i, ch in enumerate(v[:15]))
    return v[15] == chr(65 + total % 26)


def pesel(c: Context) -> bool:
    v = c.value
    if not re.fullmatch("[0-9]{11}", v):
        return False
    d = [int(ch) for ch in v]
    shift, month = divmod(d[2] * 10 + d[3], 20)
    year = {0: 1900, 1: 2000, 2: 2100, 3: 2200, 4: 1800}[shift] + d[0] * 10 + d[1]
    if not 1 <= month <= 12 or not 1 <= d[4] * 10 + d[5] <= calendar.monthrange(year, month)[1]:
        return False
    return (sum(w * x for w, x in zip((1, 3, 7, 9, 1, 3, 7, 9, 1, 3), d)) + d[10]) % 10 == 0


# --- values bound to a key

password = keyed(
    ({"database_password", "db_password", "postgres_password", "mysql_password", "redis_password", "passphrase", "private_key_passphrase", "password", "passwd", "pwd", "admin_password", "root_password"}, ".*"),
    ascii_only=False, control_free=True, sizes=(8, 1024),
)
generic_credential = keyed(
    ({"api_key", "apikey", "api_token", "access_key", "token", "access_token", "auth_token", "bearer_token", "authorization", "secret", "secret_key", "client_secret", "signing_secret", "webhook_secret"}, ".*"),
    ascii_only=False, control_free=True, sizes=(16, 2048),
)
sensitive_hash = keyed(({"password_hash", "passwd_hash", "secret_hash", "credential_hash", "api_key_hash", "token_hash"}, "(?:[0-9a-fA-F]{32}){1,4}|[0-9a-fA-F]{40}"))
aws = either(
    token("(?:AKIA|ASIA)[A-Z0-9]{16}", None),
    keyed(({"aws_secret_access_key", "secret_access_key", "aws_secret_key"}, "[A-Za-z0-9/+=]{40}"), ({"aws_session_token", "session_token", "aws_security_token"}, "[A-Za-z0-9/+=_-]{80,}")),
)
azure = keyed(
    ({"azure_client_secret", "clientsecret", "client_secret_value", "microsoft_provider_authentication_secret"}, "[A-Za-z0-9~._+/=-]{16,255}"),
    ({"account_key", "storage_account_key", "azure_storage_key"}, "[A-Za-z0-9+/=]{40,128}"),
    ({"shared_access_signature", "sas_token", "azure_sas_token"}, "(?=.*sig=)(?=.*s[ve]=).{32,}"),
)
gcp = keyed(
    ({"private_key"}, "(?i)(?=.*begin private key)(?=.*end private key).*"),
    ({"private_key_id"}, "[0-9a-fA-F]{16,128}"),
    ascii_only=False,
)


def _gcp(c: Context) -> bool:
    return gcp(c) and (plain_key(c.key() or "") != "private_key" or size(c.value) >= 64)


def _luhn(digits: str) -> bool:
    total = sum(int(ch) if i % 2 == 0 else sum(divmod(2 * int(ch), 10)) for i, ch in enumerate(reversed(digits)))
    return total % 10 == 0


def pan(c: Context) -> bool:
    names = {"pan", "primary_account_number", "card_number", "card_no", "card_num", "payment_card_number", "credit_card_number", "debit_card_number"}
    return bool(re.fullmatch("[0-9]{10,19}", c.value)) and _luhn(c.value) and key_in(c.key(), names)


def card_verification_code(c: Context) -> bool:
    names = {"cvv", "cvv2", "cvc", "cvc2", "cid", "card_verification_code", "card_verification_value", "card_security_code", "card_security_value"}
    return bool(re.fullmatch("[0-9]{3,4}", c.value)) and key_in(c.key(), names)


def nhs_number(c: Context) -> bool:
    if not re.fullmatch("[0-9]{10}|[0-9]{3}([ -])[0-9]{3}\\1[0-9]{4}", c.value):
        return False
    v = re.sub("[ -]", "", c.value)
    check = -sum((10 - i) * int(ch) for i, ch in enumerate(v[:9])) % 11
    return v not in ("1234567890", "0123456789") and check == int(v[9]) and key_in(c.key(), {"nhs_number", "nhs_no", "nhs_num", "nhsnumber"})


def ssn(c: Context) -> bool:
    form = "(?!000|666|9)[0-9]{3}(-?)(?!00)[0-9]{2}\\1(?!0000)[0-9]{4}"
    return bool(re.fullmatch(form, c.value)) and key_in(c.key(), {"ssn", "social_security_number", "socialsecuritynumber"})


def otp_provisioning_secret(c: Context) -> bool:
    v = c.value
    m = re.fullmatch("([A-Za-z2-7]+)(=*)", v)
    if not m or len(v) < 16 or placeholder(v) or (len(m[1]) % 8, len(m[2])) not in {(0, 0), (2, 6), (4, 4), (5, 3), (7, 1)}:
        return False
    if key_in(c.key(), {"otp_secret", "totp_secret", "hotp_secret"}):
        return True
    uri = c.before(KEY_WINDOW).lower().rpartition("otpauth://")
    return bool(uri[1]) and uri[2].startswith(("totp/", "hotp/")) and uri[2].rpartition("secret=")[0][-1:] in ("?", "&")


# --- encoded pairs


def _pair(data: bytes | None, text_only: bool) -> bool:
    """user:password, neither empty nor a stand-in; with text_only both must be text."""
    if data is None:
        return False
    user, colon, secret = data.partition(b":")
    if not (user and colon and secret):
        return False
    parts = []
    for part in (user, secret):
        try:
            parts.append(part.decode())
        except UnicodeDecodeError:
            if text_only:
                return False
            parts.append(None)
    if any((controlled(p) if text_only else re.search(r"[\x00-\x1f\x7f]", p)) if p is not None else re.search(rb"[\x00-\x1f\x7f]", raw) for p, raw in zip(parts, (user, secret))):
        return False
    if any(p is not None and placeholder(p) for p in parts):
        return False
    user, secret = (fold(p) if text_only and p is not None else (p or "").encode() for p in parts)
    return not (user in (b"user", b"username") and secret in (b"password", b"passwd"))


def http_basic(c: Context) -> bool:
    before = c.before(KEY_WINDOW)
    if plain_key(nearest_key(before) or "") != "authorization" or not before.rstrip().lower().endswith("basic"):
        return False
    data = canonical_base64(c.value, 2048)
    return data != b"Aladdin:open sesame" and _pair(data, False)


_JSON_PIECE = re.compile(r'"(?:\\.|[^"\\])*"|"|[{}]', re.S)


def _open_objects(text: str) -> int | None:
    """Objects left open, or None inside a string or after one } too many."""
    depth = 0
    for m in _JSON_PIECE.finditer(text):
        if m[0] == '"':
            return None
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if depth < 0:
            return None
    return depth


def docker_registry(c: Context) -> bool:
    before = c.before(16384)
    if plain_key(nearest_key(before) or "") != "auth" or not before.rstrip().endswith('"'):
        return False
    keys = [m for m in re.finditer(r'"((?:\\.|[^"\\])*)"', before, re.S) if m[1] == "auths" and re.match(r"[ \t\n\x0c\r]*:", before[m.end():])]
    if not keys:
        return False
    opened = re.match(r"[ \t\n\x0c\r]*:[ \t\n\x0c\r]*(?=\{)", before[keys[-1].end():])
    if not opened or _open_objects(before[keys[-1].end() + opened.end():].rstrip()[:-1]) != 2:
        return False
    return _pair(canonical_base64(c.value, 4096), False)


_NPM_WORDS = words("password passwd npm_token your_token your_token_here your_auth_token example_token replace_me")


def npm_registry(c: Context) -> bool:
    v, key = c.value, plain_key(c.key() or "")
    if not v or controlled(v):
        return False
    if key == "_authtoken":
        return 8 <= size(v) <= 2048 and not placeholder(v) and fold(v) not in _NPM_WORDS
    if key == "_auth":
        return _pair(canonical_base64(v, 4096), True)
    if key == "_password":
        try:
            text = (canonical_base64(v, 4096) or b"").decode()
        except UnicodeDecodeError:
            return False
        return bool(text) and not controlled(text) and not placeholder(text) and fold(text) not in _NPM_WORDS
    return False


# --- structures around the value


def _lines(text: str) -> list[str]:
    return [line.removesuffix("\r") for line in text.removesuffix("\n").split("\n")] if text else []


def _bracketed(line: str) -> str | None:
    s = line.strip()
    return s[1:-1].strip() if len(s) >= 2 and s[0] == "[" and s[-1] == "]" else None


def cargo_registry(c: Context) -> bool:
    v = c.value
    if not 1 <= size(v) <= 2048 or controlled(v) or placeholder(v):
        return False
    key = c.key() or ""
    if plain_key(key) == "cargo_registry_token" or re.fullmatch("(?is)cargo_registries_.+_token", key):
        return True
    if plain_key(key) != "token":
        return False
    sections = [s for s in map(_bracketed, (x for x in _lines(c.before(4096)) if not x.strip().startswith("#"))) if s is not None]
    return bool(sections) and (sections[-1].lower() == "registry" or (sections[-1].lower().startswith("registries.") and bool(sections[-1][11:].strip())))


_PYPI_WORDS = words("password token pypi_token your_token your_token_here example_token replace_me")


def pypi(c: Context) -> bool:
    v = c.value
    if not 8 <= size(v) <= 2048 or controlled(v) or placeholder(v) or fold(v) in _PYPI_WORDS or plain_key(c.key() or "") != "password":
        return False
    before = c.before(4096)
    if "[" not in before:  # no section
        return False
    section, pairs = None, []
    for line in before.split("\n"):
        name = _bracketed(line)
        if name:
            section, pairs = name, []
        elif not line.strip().startswith(("#", ";")):
            left, equals, right = (x.strip() for x in line.strip().partition("="))
            if left and equals and right:
                pairs.append((plain_key(left), right))
    if section is None or ("username", "__token__") not in pairs:
        return False
    return section.lower() in ("pypi", "testpypi") or any(k == "repository" and re.match("(?i)https?://", r) for k, r in pairs)


def wireguard(c: Context) -> bool:
    data = canonical_base64(c.value, 44)
    if len(c.value) != 44 or data is None or len(data) != 32 or not any(data):
        return False
    before = c.before(8192)
    wanted = {"privatekey": "interface", "presharedkey": "peer"}.get(plain_key(nearest_key(before) or ""))
    names = [line.strip()[1:-1].lower() for line in _lines(before) if line.strip().startswith("[") and line.strip().endswith("]")]
    return wanted is not None and bool(names) and names[-1] == wanted


def maven(c: Context) -> bool:
    v = c.value
    if not 1 <= size(v) <= 2048 or controlled(v) or placeholder(v) or fold(v.strip()) in words("password your_password your_password_here example_password maven_password") or (v.strip()[:1] == "{" and v.strip()[-1:] == "}"):
        return False
    before, after = fold(c.before(4096)), fold(c.after(4096))
    _, found, inside = before.rpartition(b"<servers")
    inside = b"<servers" + inside
    if not found or b"</servers" in inside or b"</server" in inside[inside.rfind(b"<server"):]:
        return False
    return b"</server" in after and b"</servers" in after


_MARKUP = re.compile(r"<!--.*?-->|<!\[cdata\[.*?\]\]>|(?P<broken><!--|<!\[cdata\[)|<(?P<close>/?)packagesourcecredentials(?![A-Za-z0-9_:-])(?P<rest>[^>]*)(?P<end>>?)", re.I | re.S)


def nuget(c: Context) -> bool:
    v = c.value
    if not v or controlled(v) or placeholder(v):
        return False
    inside = False
    for m in _MARKUP.finditer(c.before(16384)):
        if m["broken"] or (m["end"] is not None and not m["end"]):
            return False
        if m["end"]:
            inside = not m["close"] and not m["rest"].rstrip(" \t\n\x0c\r").endswith("/")
    if not inside:
        return False
    for m in _MARKUP.finditer(c.after(16384)):
        if m["broken"]:
            return False
        if m["close"]:
            return bool(m["end"])
    return False


_JSON_TOKEN = re.compile(r'[ \t\n\x0c\r]+|"(?P<s>(?:\\.|[^"\\])*)"|(?P<open>")|(?P<p>[{}\[\],:])|(?P<bare>[^ \t\n\x0c\r"{}\[\],:])', re.S)
_ESCAPES = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}


def _json_string(raw: str) -> str | None:
    if re.search(r"\\(?:[^\"\\/bfnrtu]|u(?![0-9a-fA-F]{4})|u[dD][89a-fA-F])", raw):
        return None
    return re.sub(r"\\(u....|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] == "u" and len(m[1]) == 5 else _ESCAPES.get(m[1], m[1]), raw, flags=re.S)


def _json_path(source: str, target: int) -> list[str] | None:
    """Property names above the value that holds offset ``target``, in JSON that may begin anywhere."""
    above: list[str | None] = []
    key: str | None = None
    at = 0
    here = lambda: None if key is None else [k for k in above if k is not None] + [key]
    while at < target:
        m = _JSON_TOKEN.match(source, at)
        at = m.end()
        if m["open"] is not None:
            return None
        if m["s"] is not None:
            text = _json_string(m["s"])
            if text is None:
                return None
            if at > target:
                return here()
            colon = re.compile(r"[ \t\n\x0c\r]*:").match(source, at)
            if colon:
                at, key = colon.end(), text
            else:
                key = None
        elif m["p"] is not None:
            p = m["p"]
            if p in "{[":
                above.append(key)
                key = None
            elif p in "}]":
                if not above:
                    return None
                above.pop()
                key = None
            elif p == ",":
                key = None
        elif m["bare"] is not None and key is not None:
            end = re.compile(r"[^,}\]]*").match(source, m.start()).end()
            if m.start() <= target < end:
                return here()
            at, key = end, None
    return here()


def composer(section: str, prop: str | None) -> Check:
    """The value of ``prop`` of a repository of ``section``; without prop, the repository's own value."""
    refused = words("password your_password your_password_here example_password composer_password replace_me replace_me_here")

    def check(c: Context) -> bool:
        v = c.value
        if not 1 <= size(v) <= 2048 or controlled(v) or placeholder(v) or fold(v.strip()) in refused:
            return False
        before = c.before(16384)
        path = _json_path(before + v + c.after(16384), len(before))
        tail = [prop] if prop else []
        return path is not None and len(path) >= 2 + len(tail) and path[-2 - len(tail)] == section and bool(path[-1 - len(tail)]) and path[len(path) - len(tail):] == tail

    return check


def rubygems_host(c: Context) -> bool:
    v = c.value
    return 8 <= size(v) <= 2048 and not controlled(v) and not placeholder(v) and not CHECKS["rubygems"][0](c) and key_in(c.key(), {"gem_host_api_key"})


def _assignment_line(c: Context, most: int) -> str:
    return c.before(most).rpartition("\n")[2].lstrip()


def swiftpm(c: Context) -> bool:
    v = c.value
    if not 1 <= size(v) <= 16384 or controlled(v) or placeholder(v) or fold(v.strip()) in words("replace_me replace_me_here your_password your_password_here example_password"):
        return False
    return bool(re.match(r"SWIFTPM_(?:REGISTRY_TOKEN|REGISTRY_PASSWORD|SOURCE_CONTROL_TOKEN)\s*=", _assignment_line(c, 256)))


def gradle(c: Context) -> bool:
    v = c.value
    if not 1 <= size(v) <= 2048 or controlled(v) or placeholder(v) or fold(v.strip()) in words("password changeme replace_me replace_me_here your_password your_password_here example_password"):
        return False
    return bool(re.fullmatch(r"ORG_GRADLE_PROJECT_.+(?:Password|AuthHeaderValue)\s*=", _assignment_line(c, 512), re.S))


def database_connection(c: Context) -> bool:
    v = c.value
    if not 1 <= size(v) <= 1024 or controlled(v) or placeholder(v) or re.search("%(?![0-9A-Fa-f]{2})", v):
        return False
    before = c.before(256).lower()
    tails = (before.rpartition(s + "://") for s in ("postgres", "postgresql", "mysql", "mariadb", "mongodb", "mongodb+srv", "redis", "rediss"))
    return any(found and rest.endswith(":") for _, found, rest in tails)


def _netrc_words(text: str) -> Iterator[str]:
    for line in _lines(text):
        yield from line.partition("#")[0].split()


def _netrc_record(before: str) -> bool:
    """A machine with its name, then a login with its value, then the word password, all still in force."""
    if "machine" not in before or "login" not in before:
        return False
    state = "none"  # none, machine?, machine, login?, login, password
    for word in _netrc_words(before):
        if state == "machine?":
            state = "machine"
        elif state == "login?":
            state = "login"
        elif word == "machine":
            state = "machine?"
        elif word in ("default", "macdef"):
            state = "none"
        elif word == "login" and state in ("machine", "login", "password"):
            state = "login?"
        elif word == "password" and state in ("login", "password"):
            state = "password"
    return state == "password"


_NETRC_WORDS = words("password passwd your_password your_password_here example_password replace_me")


def _netrc(value: str, before: str) -> bool:
    if not 1 <= size(value) <= 1024 or re.search(r"\s", value) or controlled(value) or placeholder(value) or fold(value) in _NETRC_WORDS:
        return False
    return _netrc_record(before)


def netrc(c: Context) -> bool:
    return _netrc(c.value, c.before(16384))


def swiftpm_netrc(c: Context) -> bool:
    before = c.before(16384)
    if "SWIFTPM_NETRC_DATA" not in before:
        return False
    quoted = list(re.finditer(r"(?<![^\n\r \t])SWIFTPM_NETRC_DATA(?=[= \t])\s*=\s*[\"']", before))
    return bool(quoted) and _netrc(c.value, before[quoted[-1].end():])


_CRYPT = "[./A-Za-z0-9]"
_HTPASSWD = re.compile(rf"\$apr1\${_CRYPT}{{1,8}}\${_CRYPT}{{22}}|\$2[aby]\$(?:0[4-9]|[12][0-9]|3[01])\${_CRYPT}{{53}}")


def system_password_verifier(c: Context) -> bool:
    v = c.value
    if not 1 <= size(v) <= 1024 or re.search(r"[ \t\n\x0c\r]", v):
        return False
    left = c.before(4096).rpartition("\n")[2]
    right = c.after(4096).partition("\n")[0]
    if not re.fullmatch(r"[^: \t\n\x0c\r]+:", left):
        return False
    if re.match(r"\$[56y]\$", v):
        return bool(re.fullmatch("(?::[0-9]*){7}", right))
    return bool(_HTPASSWD.fullmatch(v)) and right.removesuffix("\r" if "\n" in c.after(4096) else "") == ""


_TOKENS = {
    "github": token(rf"(?:github_pat_|gh[opusr]_)(?P<p>[A-Za-z0-9_]{{20,}})|ghs_[0-9]+_{_B64URL}\.{_B64URL}\.{_B64URL}"),
    "gitlab": token("(?:glagent|glrtr|glsoat|glffct|glpat|gloas|gldt|glrt|glcbt|glptt|glft|glimt|glwt)-(?P<p>[A-Za-z0-9_]{8,})", refused=_gitlab_refused),
    "stripe": token("(?:[sr]k_(?:live|test)_|whsec_)(?P<p>[A-Za-z0-9_]{16,})"),
    "cloudflare": token("cf(?:k|ut|at)_[A-Za-z0-9]{40}[0-9a-fA-F]{8}", None),
    "slack": token("(?=.{24,})(?:xoxb|xoxp|xapp|xwfp)-(?P<p>[A-Za-z0-9_]+(?:-[A-Za-z0-9_]+)*)", 512),
    "telegram": token("[0-9]{5,20}:(?P<p>[A-Za-z0-9_-]{20,128})", 149),
    "rubygems": token("rubygems_[0-9a-fA-F]{32,}", 2048),
    "tailscale": token(r"tskey-(?:api|auth|client|scim|webhook)-(?P<p>[!-~]+)", 2048, _tailscale_refused),
}

DETERMINISTIC, CONTEXTUAL = "deterministic", "contextual"

#: name -> (check, priority, confidence, detection mode)
CHECKS: dict[str, tuple[Check, int, str, str]] = {"none": (lambda c: True, 0, "high", "matcher_only")}
CHECKS |= {k: (v, 500, "high", DETERMINISTIC) for k, v in _TOKENS.items()}
CHECKS |= {"jwt": (jwt, 300, "medium", DETERMINISTIC), "nats": (nats, 300, "high", DETERMINISTIC)}
CHECKS |= {f.__name__: (f, 500, "high", DETERMINISTIC) for f in (iban, codice_fiscale, pesel)}
CHECKS |= {f.__name__: (f, 500, "high", CONTEXTUAL) for f in (pan, card_verification_code, nhs_number, ssn, otp_provisioning_secret, cargo_registry, pypi, maven, nuget, rubygems_host, swiftpm, swiftpm_netrc, gradle)}
CHECKS |= {"aws": (aws, 500, "high", CONTEXTUAL), "azure": (azure, 500, "high", CONTEXTUAL), "gcp": (_gcp, 500, "high", CONTEXTUAL)}
CHECKS |= {f.__name__: (f, 200, "high", CONTEXTUAL) for f in (database_connection, http_basic, wireguard, docker_registry, npm_registry, netrc, system_password_verifier)}
CHECKS |= {"password": (password, 200, "medium", CONTEXTUAL), "sensitive_hash": (sensitive_hash, 200, "medium", CONTEXTUAL), "generic_credential": (generic_credential, 100, "medium", CONTEXTUAL)}
CHECKS |= {
    "composer_http_basic_password": (composer("http-basic", "password"), 500, "high", CONTEXTUAL),
    "composer_bearer_token": (composer("bearer", None), 500, "high", CONTEXTUAL),
    "composer_bitbucket_consumer_secret": (composer("bitbucket-oauth", "consumer-secret"), 500, "high", CONTEXTUAL),
    "composer_forgejo_token": (composer("forgejo-token", "token"), 500, "high", CONTEXTUAL),
}
