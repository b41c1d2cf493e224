"""Transformations of one text at its findings. Spans are UTF-8 bytes, as in reports."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

from .blake3 import digest, digests

MARKER, PSEUDONYM, NAMESPACE, DOMAIN = "veil_synthetic", "veil_pseudo_", "VEIL", b"veilscan:synthesis:v1\0"


class TransformError(ValueError):
    """``kind``: invalid_span, span_out_of_bounds, invalid_utf8_boundary or overlapping_spans."""

    def __init__(self, kind: str) -> None:
        super().__init__(kind)
        self.kind = kind


Span = tuple[int, int, str]  # start, end, rule id


def checked(data: bytes, spans: list[Span]) -> list[Span]:
    for start, end, _ in spans:
        if start >= end:
            raise TransformError("invalid_span")
        if end > len(data):
            raise TransformError("span_out_of_bounds")
        if any(at < len(data) and data[at] & 0xC0 == 0x80 for at in (start, end)):
            raise TransformError("invalid_utf8_boundary")
    return sorted(spans)


def _replaced(text: str, spans: list[Span], value: Callable[[bytes, Span], str], merge: bool = False) -> str:
    data = text.encode("utf-8", "surrogatepass")
    out, at = [], 0
    ordered = checked(data, spans)
    if merge:
        joined: list[Span] = []
        for s in ordered:  # spans that only touch stay apart
            if joined and s[0] < joined[-1][1]:
                joined[-1] = (joined[-1][0], max(joined[-1][1], s[1]), joined[-1][2])
            else:
                joined.append(s)
        ordered = joined
    elif any(b[0] < a[1] for a, b in zip(ordered, ordered[1:])):
        raise TransformError("overlapping_spans")
    for s in ordered:
        out += [data[at:s[0]], value(data, s).encode("utf-8", "surrogatepass")]
        at = s[1]
    return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass")


def redact(text: str, spans: list[Span], replacement: str = "[REDACTED]") -> str:
    return _replaced(text, spans, lambda *_: replacement, merge=True)


def component(value: str, fallback: str) -> str:
    """Characters of a template name; runs of others become one hyphen, none at the edges."""
    return re.sub("[^A-Za-z0-9._-]+", "-", re.sub("^[^A-Za-z0-9._-]+", "", value)).rstrip("-") or fallback


def template(text: str, spans: list[Span], namespace: str = NAMESPACE, numbered: bool = False) -> str:
    seen: Counter[str] = Counter()

    def name(_: bytes, s: Span) -> str:
        seen[s[2]] += 1
        return f"<{component(namespace, NAMESPACE)}:{component(s[2], 'finding')}{f':{seen[s[2]]}' if numbered else ''}>"

    return _replaced(text, spans, name)


def pseudonymize(text: str, spans: list[Span], key: bytes, prefix: str = PSEUDONYM, digest_bytes: int = 16, known: dict[bytes, bytes] | None = None) -> str:
    """``known``: digests at hand, as ``ShareMode.known`` makes them."""
    size, known = min(32, max(8, digest_bytes)), known or {}
    return _replaced(text, spans, lambda data, s: prefix + (known.get(data[s[0]:s[1]]) or digest(data[s[0]:s[1]], size, key)).hex())


# --- synthesis: values of the same length that no check accepts

_ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_"

# Prefix and first body character of synthetic tokens.
TOKEN_PREFIXES = {
    "github.classic-pat": "ghp_", "github.fine-grained-pat": "github_pat_", "github.oauth-token": "gho_", "github.app-user-token": "ghu_", "github.app-installation-token": "ghs_", "github.app-refresh-token": "ghr_",
    "gitlab.access-token": "glpat-", "gitlab.oauth-application-secret": "gloas-", "gitlab.deploy-token": "gldt-", "gitlab.runner-auth-token": "glrt-", "gitlab.registration-derived-runner-auth-token": "glrtr-",
    "gitlab.ci-job-token": "glcbt-", "gitlab.trigger-token": "glptt-", "gitlab.feed-token": "glft-", "gitlab.incoming-mail-token": "glimt-", "gitlab.agent-token": "glagent-", "gitlab.workspace-token": "glwt-",
    "gitlab.scim-token": "glsoat-", "gitlab.feature-flag-client-token": "glffct-", "stripe.live-secret-key": "sk_live_", "stripe.test-secret-key": "sk_test_", "stripe.live-restricted-key": "rk_live_",
    "stripe.test-restricted-key": "rk_test_", "stripe.webhook-secret": "whsec_", "cloudflare.global-api-key": "cfk_", "cloudflare.user-api-token": "cfut_", "cloudflare.account-api-token": "cfat_",
    "slack.bot-token": "xoxb-", "slack.user-token": "xoxp-", "slack.app-level-token": "xapp-", "slack.workflow-token": "xwfp-", "rubygems.api-key": "rubygems_", "tailscale.api-access-token": "tskey-api-",
    "tailscale.auth-key": "tskey-auth-", "tailscale.oauth-client-secret": "tskey-client-", "tailscale.scim-key": "tskey-scim-", "tailscale.webhook-key": "tskey-webhook-", "nats.nkey-seed": "S", "nats.nkey-private-key": "P",
    "personal.it-codice-fiscale": "", "personal.pl-pesel": "", "personal.uk-nhs-number": "", "personal.us-ssn": "", "financial.card-verification-code": "",
}
INVALID_BODY = {"aws.access-key-id": ("AKIA", "s"), "aws.temporary-access-key-id": ("ASIA", "s"), "nuget.package-source-cleartext-password": ("", "\0"), "maven.server-password": ("", "\0")} | {k: (v, "!") for k, v in TOKEN_PREFIXES.items()}


def _pem(name: str, newline: str = "\\n") -> str:
    return f"-----BEGIN VEIL SYNTHETIC {name}-----{newline}invalid{newline}-----END VEIL SYNTHETIC {name}-----"


# Texts that synthetic values of a rule begin with.
BASES = {
    "github.stateless-installation-token": "ghs_0_SYNTHETIC.invalid.token!", "telegram.bot-token": "00000:VEIL_SYNTHETIC_BOT_TOKEN!", "jwt.signed-compact": "eyS.synthetic.payload.invalid!",
    "generic.pkcs8-private-key": _pem("PKCS8 PRIVATE KEY"), "generic.encrypted-private-key": _pem("ENCRYPTED PRIVATE KEY"), "generic.rsa-private-key": _pem("RSA PRIVATE KEY"), "generic.ec-private-key": _pem("EC PRIVATE KEY"),
    "generic.openssh-private-key": _pem("OPENSSH PRIVATE KEY"), "generic.pgp-private-key": _pem("PGP PRIVATE KEY BLOCK"), "gcp.private-key": _pem("PRIVATE KEY"), "gcp.escaped-private-key": _pem("PRIVATE KEY", "\\\\n"),
    "aws.secret-access-key": "VEIL_SYNTHETIC_AWS_SECRET!", "aws.session-token": "VEIL_SYNTHETIC_AWS_SESSION!", "azure.storage-account-key": "VEIL_SYNTHETIC_AZURE_STORAGE!", "azure.shared-access-signature": "VEIL_SYNTHETIC_AZURE_SAS!",
    "gcp.private-key-id": "g000000000000000_veil_synthetic", "generic.sensitive-hash": "g_veil_synthetic_hash",
}

# The word that names a rule in its marker, where it is not the rule id's own words.
FAMILIES = {
    "npm.registry-auth-token": "npm_auth_token", "npm.registry-auth": "npm_legacy_auth", "npm.registry-password": "npm_password", "generic.password-field": "password", "generic.database-password-field": "database_password",
    "generic.database-connection-password": "database_connection_password", "generic.passphrase-field": "passphrase", "generic.api-key": "api_key", "generic.auth-token": "auth_token", "generic.authorization-bearer": "authorization_bearer",
    "generic.authorization-basic": "authorization_basic", "generic.secret": "secret", "mfa.otp-provisioning-secret": "otp_provisioning_secret", "system.shadow-password-verifier": "shadow_password_verifier", "system.htpasswd-password-verifier": "htpasswd_password_verifier",
    "azure.client-secret": "azure_client_secret", "docker.registry-auth": "docker_registry_auth",
}
_OWN_WORDS = ("composer.", "cargo.", "pypi.", "rubygems.", "swiftpm.", "gradle.", "netrc.", "wireguard.")


@dataclass
class _Bytes:
    """Keyed byte stream of one span."""

    key: bytes
    seed: bytes
    have: bytes = b""
    at: int = 0

    def take(self, n: int) -> bytes:
        while len(self.have) < self.at + n:
            self.have = digest(self.seed, max(64, 2 * len(self.have)), self.key)
        self.at += n
        return self.have[self.at - n:self.at]

    def letters(self, n: int) -> str:
        return "".join(_ALPHABET[b % len(_ALPHABET)] for b in self.take(n))

    def digits(self, n: int) -> str:
        return "".join(str(b % 10) for b in self.take(n))


def _padded(base: str, size: int, r: _Bytes) -> str:
    """The base and random letters; a base that does not fit is cut so that up to 4 letters are random."""
    keep = base if len(base) < size else base[:max(0, size - 4)]
    return keep + r.letters(size - len(keep))


def _synthetic(rule: str, size: int, marker: str, r: _Bytes) -> str:
    if rule == "financial.iban":
        return "ZZ00" + r.digits(size - 4) if size >= 4 else _padded("ZZ00", size, r)
    if rule == "financial.pan":
        d = r.digits(size)
        if not 10 <= size <= 19:
            return d
        total = sum(int(ch) if i % 2 else sum(divmod(2 * int(ch), 10)) for i, ch in enumerate(reversed(d[:-1])))
        return d[:-1] + str((10 - total % 10 + 1) % 10)
    if rule == "personal.uk-nhs-number" and size == 12:
        return f"!{r.digits(2)}-{r.digits(3)}-{r.digits(4)}"
    if rule == "personal.us-ssn" and size == 11:
        return f"!{r.digits(2)}-{r.digits(2)}-{r.digits(4)}"
    if rule in INVALID_BODY:
        prefix, wrong = INVALID_BODY[rule]
        return prefix + wrong + r.letters(size - len(prefix) - 1) if size > len(prefix) else _padded("SYNTH", size, r)
    if rule in BASES:
        return _padded(BASES[rule], size, r)
    family = FAMILIES.get(rule) or (re.sub("[.-]", "_", rule) if rule.startswith(_OWN_WORDS) else "value")
    return _padded(f"{marker}_{family}_", size, r)


def _seed(domain: bytes, s: Span) -> bytes:
    return domain + s[2].encode() + b"\0" + s[0].to_bytes(8, "little") + s[1].to_bytes(8, "little")


def synthesize(text: str, spans: list[Span], key: bytes, marker: str = MARKER, domain: bytes = DOMAIN, known: dict[bytes, bytes] | None = None) -> str:
    """``known``: beginnings of keyed streams at hand, as ``ShareMode.known`` makes them."""
    known = known or {}
    marker = re.sub("[^A-Za-z0-9_-]", "_", marker) or MARKER

    def value(_: bytes, s: Span) -> str:
        seed = _seed(domain, s)
        return _synthetic(s[2], s[1] - s[0], marker, _Bytes(key, seed, known.get(seed, b"")))

    return _replaced(text, spans, value)


@dataclass(frozen=True)
class ShareMode:
    """redact, template, pseudonymize or synthesize, with its options (never shown: they may hold a key)."""

    kind: str
    options: dict = field(default_factory=dict, repr=False)

    def apply(self, text: str, spans: list[Span], known: dict[bytes, bytes] | None = None) -> str:
        more = {"known": known} if known else {}
        return {"redact": redact, "template": template, "pseudonymize": pseudonymize, "synthesize": synthesize}[self.kind](text, spans, **self.options, **more)

    def known(self, texts: list[str], spans: list[list[Span]]) -> dict[bytes, bytes]:
        """The digests that a keyed mode needs for many texts, made together; others stay to be made one by one."""
        if self.kind == "pseudonymize":
            values = set()
            for text, found in zip(texts, spans):
                if found:
                    data = text.encode("utf-8", "surrogatepass")
                    values.update(data[s:e] for s, e, _ in found if 0 <= s < e <= len(data))
            return digests(values, min(32, max(8, self.options.get("digest_bytes", 16))), self.options["key"])
        if self.kind == "synthesize":
            domain, by_size = self.options.get("domain", DOMAIN), {}
            for found in spans:
                for x in found:
                    if 0 <= x[0] < x[1]:
                        by_size.setdefault(64 << (max(0, x[1] - x[0] - 1) // 64).bit_length(), set()).add(_seed(domain, x))
            return {m: d for size, seeds in by_size.items() if size <= 8192 for m, d in digests(seeds, size, self.options["key"]).items()}
        return {}
