"""Surrogates for personal data: keyed, type-consistent, and distinct for distinct entities.

Every entity is reduced to a canonical form (digits of a phone number with its country code, lower
case of an address), so that all its spellings in all documents share one surrogate without any
exchange between machines. The surrogate comes from a keyed permutation of the entity's own
format. Formats of up to 2^256 values are numbered in mixed radix, and a Feistel network over that
domain is conjugated with a step by one (no value maps to itself); longer ones go through Feistel
rounds that add a key stream place by place, in time linear in the length. Values that fail the
format's check are walked past. A permutation has no collisions inside one format; across
formats ``distinct_surrogates`` checks the whole corpus and draws again under a derived key if
two entities share a surrogate (an error after ``draws`` keys).

Formats keep lengths, separators, letter case, script, Luhn validity, private or public address
space, and the country of a phone number or IBAN. Names keep script and gender: listed given names
and surnames map inside their list, other words keep their pattern of vowels and consonants and
their last letter and never enter a list. A word has the same surrogate wherever it stands in a
name; the form of address has no part in it.

Names are found after a form of address, by a listed given name, or by a phrase that introduces
somebody ("my name is", "Name:"); words of places, offices, days and months end or rule out a name,
so "Victoria Station" and "Prime Minister" stay. Chinese ones are found by a listed surname and a
form of address, Arabic ones by a form of address. Once found, their words are replaced in the rest
of the text too. Names without any of these signs stay: no list is complete. Secrets are found by
their form, in quotes, or as the value assigned to a name such as api_key if it looks random.

Defined cases: null texts stay null; empty texts stay empty; repeated rows get equal results; of
overlapping entities the one that begins first counts (numbers and addresses before names);
columns other than text (and n_chars) are carried unchanged, whatever their names; texts and
values of any length are handled whole; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
import ipaddress
import math
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm.common import documents, stored

KINDS = ("email", "ip", "mac", "phone", "card", "iban", "ssn", "secret", "name")
#: For tests and examples; a production run passes its own secret.
EXAMPLE_KEY = b"inkstone example key"

#: Listed names by script and gender (f, m) and surnames (s); parameters of the operator, kept apart by script.
NAMES = {
    ("latin", "f"): (
        "Alice Amina Anna Barbara Catherine Charlotte Dorothy Elizabeth Emily Fatima Frances Gabriele Hannah Ingrid Isabelle Jennifer Josephine Katharina Laura Linda Lucy Margaret Maria Mary "
        "Nancy Olivia Patricia Priya Rebecca Sarah Sophie Susan Ursula Victoria Aisha Akiko Amanda Ana Andrea Angela Anita Ashley Brenda Camila Carmen Carol Caroline Chloe Christine Clara Deborah "
        "Diana Donna Elena Emma Eva Giulia Helen Ines Jane Jessica Julia Karen Kimberly Leila Lucia Mei Melissa Michelle Nadia Natalie Nicole Nina Pamela Rachel Ruth Sandra Sharon Stephanie Teresa Yuki Zainab"
    ).split(),
    ("latin", "m"): (
        "Ahmed Albert Benjamin Carlos Charles Daniel David Edward Frederick George Henry Jacques James John José Joseph Juan Klaus Lucas Michael Mohammed Nicholas Oliver Patrick Paul Peter "
        "Pierre Quentin Rajesh Richard Robert Stephen Thomas William Alan Alejandro Alexander Ali Andrew Anthony Antonio Arjun Bob Brian Christopher Diego Dmitri Donald Eric Fernando Francisco Gary Giovanni "
        "Hans Hassan Hiroshi Ibrahim Igor Ivan Jason Jeffrey Jorge Kenji Kenneth Kevin Lars Luis Luigi Marco Mario Matthew Miguel Mustafa Omar Pablo Pedro Rahul Ravi Ronald Samuel Scott Sergio Steven Takeshi Timothy Wei Yusuf"
    ).split(),
    ("latin", "s"): (
        "Adams Baker Campbell Dupont Evans Fischer Garcia Hoffmann Jackson Johnson Klein Lambert Martin Müller Murphy Novak Parker Roberts Schmidt Sharma Smith Taylor Walker Watson Williams Young"
    ).split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Ирина Мария Наталья Ольга Светлана".split(),
    ("cyrillic", "m"): "Александр Борис Виктор Дмитрий Иван Михаил Николай Павел Сергей Юрий".split(),
    ("cyrillic", "s"): "Волков Зайцев Козлов Лебедев Морозов Новиков Орлов Павлов Соколов Фёдоров".split(),
    ("greek", "f"): "Αθηνά Βασιλική Ελένη Κατερίνα Μαρία Σοφία".split(),
    ("greek", "m"): "Αντώνης Γιώργος Δημήτρης Κώστας Νίκος Παύλος".split(),
    ("greek", "s"): "Αγγέλου Γεωργίου Δημητρίου Ιωάννου Νικολάου Παπαδόπουλος".split(),
}
#: Chinese surnames, and characters of given names of either gender, one character each.
HAN = {"s": "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗", "f": "芳娜静丽娟艳霞玲秀燕", "m": "伟强磊军勇杰涛超刚辉"}
#: Forms of address by gender ("" where they tell none).
TITLES = {
    "m": "Mr Mister Sir Herr Herrn Monsieur Señor Sr Don господин г-н Κύριος".split(),
    "f": "Mrs Ms Miss Madam Frau Madame Mme Mademoiselle Señora Sra Doña госпожа г-жа Κυρία".split(),
    "": "Dr Prof".split(),
}
HAN_TITLES, ARABIC_TITLES = "先生 女士 小姐 太太 老师 教授 医生 博士".split(), "السيد السيدة الدكتور الدكتورة الأستاذ الأستاذة".split()
#: Phrases that introduce a person; capitalised words that begin no name; and words that are no part of one (places, offices, bodies, times).
CUES = ("my name is", "i am called", "name:", "signed:", "patient:")
NO_NAMES = "The This That These Those Our His Her My Your Their In On At When If But And So We They He She It You Some Many Most All Its Not None Unknown".split()
NO_PART = (
    "Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July August September October November December "
    "Airport Avenue Bay Beach Bridge Building Castle Cathedral Church Cinema City College County Court Cross Falls Garden Gardens Hall Harbour Hill Hospital Hotel House Island Islands Lake Library Lines "
    "Market Mountain Museum Observatory Observer Opera Palace Park Port Prize Province River Road School Square Stadium State Station Street Theatre Times Tower University Valley Village Zoo "
    "Academy Agency Association Authority Bank Board Bureau Centre Center Club Commission Committee Company Corporation Council Department Desk Division Foundation Group Institute Journal League Ministry "
    "Minister Nations News Office Organization Party Post President Press Prime Records Sales Secretary Service Services Society Support Team Trust Union United"
).split()
_LISTED = {name.lower(): (script, kind) for (script, kind), names in NAMES.items() for name in names}

#: Alphabets of one script, case and kind each; a letter is only ever replaced within its own.
ALPHABETS = (
    "0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "àâäáåãæèéêëìíîïòóôõöøùúûü", "çñýþðß",
    "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "άέήίόύώ", "بتثجحخدذرزسشصضطظعغفقكلمنه",
)
_ALPHABET_OF = {c: a for a in ALPHABETS for c in a}
_HAN = "".join(map(chr, range(0x4E00, 0x9FA6)))
_WHOLE = "abcdefghijklmnopqrstuvwxyz"
_HEX = "0123456789abcdef"

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_TEXTUAL = {
    "email": r"(?<![\w.+-])[\w+-]+(?:\.[\w+-]+)*@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "mac": r"(?<![\w:-])[0-9A-Fa-f]{2}(?:(?::[0-9A-Fa-f]{2}){5}|(?:-[0-9A-Fa-f]{2}){5})(?![\w:-])",
    "phone": r"(?<![\d+])\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\d+])\+(?!1\D)\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,5}(?!\d)|(?<!\d)(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?!\d)",
    "card": r"(?<![\d.-])(?:\d{4}[ -]){3}\d{4}(?![\d-])|(?<![\w.])\d{13,19}(?![0-9A-Za-z])",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "secret": r"(?<![0-9A-Za-z])(?=[a-fA-F]*\d)(?=\d*[a-fA-F])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z])|(?<=[\"'])[A-Za-z0-9+/_-]{20,}(?=[\"'])|\b(?:sk|ghp|AKIA)[-_]?[A-Za-z0-9]{16,}\b",
}
_WITH_DIGITS = re.compile("|".join(f"(?P<{k}>{p})" for k, p in _TEXTUAL.items()))
_TITLED = "|".join(sorted((re.escape(t) for ts in TITLES.values() for t in ts), key=len, reverse=True))
_GIVEN = "|".join(n for (_, kind), ns in NAMES.items() if kind in "fm" for n in ns)
_CAPITAL = r"[A-ZÀ-ÖØ-ÞА-ЯЁΑ-ΩΆΈΉΊΌΎΏ][^\W\d_]*[^\W\d_A-ZÀ-ÖØ-ÞА-ЯЁΑ-Ω]"
_NONE = rf"(?!(?:{'|'.join(NO_NAMES + NO_PART)})\b)"
_PART = rf"(?!(?:{'|'.join(NO_PART)})\b){_CAPITAL}"
_NAMED = re.compile(
    rf"\b(?:(?:{_TITLED})\b\.? (?P<titled>{_PART}(?: {_PART})?)|(?P<listed>(?:{_GIVEN}) {_PART})(?! (?:{'|'.join(NO_PART)})\b))(?!\w)"
    rf"|(?<!\w)(?i:{'|'.join(re.escape(c) for c in CUES)}) (?P<cued>{_NONE}{_CAPITAL}(?: {_PART})?)(?!\w)(?! (?:{'|'.join(NO_PART)})\b)"
)
#: An IPv6 address in any spelling (what is none is ruled out afterwards), a value assigned to a name, and names of secret values.
_IPV6 = re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f]*:)[0-9A-Fa-f:]{4,39}(?![\w:])")
_ASSIGNED = re.compile(r"[=:][ \t]*[\"']?([^\s\"',;(){}<>\[\]]{8,})")
_SECRET_NAME = re.compile(r"(?i)(?:secret|token|passw(?:or)?d|passphrase|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth[_-]?key|credential)s?[\w.-]{0,30}[\"']?[ \t]*$")
_SPACED_SSN = re.compile(r"(?i)(?:ssn|social security(?: number| no)?)[ .:#]{1,4}(?:is )?(\d{3} \d{2} \d{4})(?!\d)")
_HAN_NAMED = re.compile(rf"(?P<han>[{HAN['s']}][\u4e00-\u9fa5]{{1,2}}?)(?={'|'.join(HAN_TITLES)})")
_ARABIC_NAMED = re.compile(rf"(?<!\w)(?:{'|'.join(ARABIC_TITLES)}) (?P<arabic>[\u0620-\u064a]{{2,}}(?: [\u0620-\u064a]{{2,}})?)")


class Permutation:
    """Keyed permutation of 0..size-1 (2^MOST_BITS at most): Feistel rounds over the next even number of bits, walked back into range."""

    ROUNDS = 6

    def __init__(self, key: bytes, tweak: str, size: int) -> None:
        self.size, self.half = size, max(1, (max(1, size - 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1
        seed = hashlib.blake2b(tweak.encode(), key=hashlib.sha256(key).digest(), digest_size=32).digest()
        self.keys = [hashlib.blake2b(bytes([r]), key=seed, digest_size=32).digest() for r in range(self.ROUNDS)]

    def _mix(self, r: int, x: int) -> int:
        raw = hashlib.blake2b(x.to_bytes((self.half + 7) // 8, "big"), key=self.keys[r], digest_size=(self.half + 7) // 8).digest()
        return int.from_bytes(raw, "big") & self.mask

    def _walk(self, x: int, rounds: list[int], back: bool) -> int:
        while True:
            left, right = x >> self.half, x & self.mask
            for r in rounds:
                left, right = (right ^ self._mix(r, left), left) if back else (right, left ^ self._mix(r, right))
            x = left << self.half | right
            if x < self.size:
                return x

    def forth(self, x: int) -> int:
        return self._walk(x, list(range(self.ROUNDS)), False)

    def back(self, x: int) -> int:
        return self._walk(x, list(range(self.ROUNDS))[::-1], True)

    def step(self, x: int) -> int:
        """A permutation without fixed points (size over 1)."""
        return self.back((self.forth(x) + 1) % self.size)


@lru_cache(maxsize=4096)
def _permutation(key: bytes, tweak: str, size: int) -> Permutation:
    return Permutation(key, tweak, size)


#: Bits of the largest domain that is numbered; beyond, key streams permute place by place.
MOST_BITS = 256


def _streamed(key: bytes, tweak: str, digits: list[int], sizes: list[int]) -> list[int]:
    """A keyed permutation of digits below sizes: Feistel rounds in which one half's key stream is added to the other."""
    halves = [len(digits) // 2, len(digits)]
    parts, bounds = [digits[: halves[0]], digits[halves[0] :]], [sizes[: halves[0]], sizes[halves[0] :]]
    seed = hashlib.blake2b(tweak.encode(), key=hashlib.sha256(key).digest(), digest_size=32).digest()
    for r in range(Permutation.ROUNDS):
        into, source = r % 2, parts[1 - r % 2]
        stream = hashlib.shake_256(seed + bytes([r]) + array("H", source).tobytes()).digest(4 * len(parts[into]))
        parts[into] = [(x + k) % n for x, k, n in zip(parts[into], array("I", stream), bounds[into], strict=True)]
    return parts[0] + parts[1]


def permuted(key: bytes, kind: str, value: str, alphabets: list[str], valid: Callable[[str], bool] = lambda _: True) -> str:
    """The next valid value of the same places; alphabets has "" for a place that stays."""
    shape = "".join(chr(33 + len(a)) if a else c for c, a in zip(value, alphabets, strict=True))
    sizes = [len(a) for a in alphabets if a]
    digits = [a.index(c) for c, a in zip(value, alphabets, strict=True) if a]
    if max(sizes, default=1) < 2:
        return value
    short = sum(map(math.log2, sizes)) <= MOST_BITS
    if short:
        size, x = 1, 0
        for d, n in zip(digits, sizes, strict=True):
            size, x = size * n, x * n + d
        steps = _permutation(key, f"{kind}\0{shape}", size)
    while True:
        if short:
            x = y = steps.step(x)
            for k in range(len(sizes) - 1, -1, -1):
                y, digits[k] = divmod(y, sizes[k])
        else:
            digits = _streamed(key, f"{kind}\0{shape}", digits, sizes)
        it = iter(digits)
        if valid(made := "".join(a[next(it)] if a else c for c, a in zip(value, alphabets, strict=True))):
            return made


def _recased(like: str, made: str) -> str:
    """made with capitals where like has them (all of it if like is all capitals)."""
    if len(like) != len(made):
        return made.upper() if like.isupper() else made
    return "".join(m.upper() if c.isupper() and len(m.upper()) == 1 else m for c, m in zip(like, made, strict=True))


def _low(text: str) -> str:
    """Lower case of the same length."""
    return "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _digits_like(like: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isascii() and c.isdigit() else c for c in like)


def _places(value: str, letters: str = "") -> list[str]:
    return ["0123456789" if c in "0123456789" else letters if letters and c in letters else _ALPHABET_OF.get(c, "") for c in value]


def _is_ipv6(text: str) -> bool:
    try:
        ipaddress.IPv6Address(text)
    except ValueError:
        return False
    return True


def luhn(digits: str) -> bool:
    odd = [int(d) for d in digits[-1::-2]]
    even = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(odd) + sum(even)) % 10 == 0


def _private(octets: list[int]) -> str:
    a, b = octets[0], octets[1]
    return "loop" if a == 127 else "10" if a == 10 else "172" if a == 172 and 16 <= b < 32 else "192" if a == 192 and b == 168 else "zero" if a == 0 else "multi" if a >= 224 else "public"


def _space(address: ipaddress.IPv6Address) -> str:
    return "link" if address.is_link_local else "multi" if address.is_multicast else "local" if address in _UNIQUE_LOCAL else "global" if address in _GLOBAL else "other"


def looks_random(value: str) -> bool:
    """Letters and digits, or three kinds of characters, that differ enough (2.5 bits each) to be a secret and no word or path."""
    kinds = [bool(re.search(k, value)) for k in (r"[a-z]", r"[A-Z]", r"\d", r"[^A-Za-z0-9]")]
    n = len(value)
    bits = -sum(c / n * math.log2(c / n) for c in (value.count(x) for x in set(value)))
    return bits >= 2.5 and (kinds[2] and (kinds[0] or kinds[1]) or sum(kinds) >= 3) and "://" not in value


def _iban_check(country: str, rest: str) -> str:
    number = "".join(str(int(c, 36)) for c in rest + country + "00")
    return f"{98 - int(number) % 97:02d}"


def script_of(word: str) -> str:
    low = word.lower()
    return "cyrillic" if re.search("[а-яё]", low) else "greek" if re.search("[α-ωάέήίόύώ]", low) else "arabic" if re.search("[\u0620-\u064a]", low) else "latin"


# Country calling codes of two digits (1 and 7 have one, all others three).
TWO_DIGITS = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()


def country_code(digits: str) -> str:
    """The calling code at the start of an international number."""
    return digits[: 1 if digits[:1] in ("1", "7") else 2 if digits[:2] in TWO_DIGITS else 3]


_UNIQUE_LOCAL, _GLOBAL = ipaddress.ip_network("fc00::/7"), ipaddress.ip_network("2000::/3")


class Surrogates:
    """Canonical forms and surrogates under one key."""

    def __init__(self, key: bytes) -> None:
        self.key = key

    def email(self, found: str) -> tuple[str, str]:
        low = _low(found)
        local, _, domain = low.rpartition("@")
        labels = domain.split(".")
        host = [x if x == "example" else permuted(self.key, "host", x, _places(x, _WHOLE), lambda made: made != "example") for x in labels[:-1]]
        made = permuted(self.key, "local", local, _places(local, _WHOLE)) + "@" + ".".join([*host, labels[-1]])
        return low, _recased(found, made)

    def ip(self, found: str) -> tuple[str, str]:
        octets = [int(x) for x in found.split(".")]
        space, steps = _private(octets), _permutation(self.key, "ip", 1 << 32)
        x = int.from_bytes(bytes(octets), "big")
        while True:
            x = steps.step(x)
            if _private(made := list(x.to_bytes(4, "big"))) == space:
                return found, ".".join(map(str, made))

    def ipv6(self, found: str) -> tuple[str, str]:
        """The address whatever its spelling; a short spelling gets one."""
        address = ipaddress.IPv6Address(found)
        steps, x, space = _permutation(self.key, "ipv6", 1 << 128), int(address), _space(address)
        while _space(made := ipaddress.IPv6Address(x := steps.step(x))) != space:
            pass
        out = made.exploded if len(found) == 39 else str(made)
        return address.exploded, out.upper() if found.isupper() else out

    def mac(self, found: str) -> tuple[str, str]:
        low = found.lower().replace("-", ":")
        made = permuted(self.key, "mac", low, ["" if c == ":" else _HEX for c in low])
        out = made.replace(":", found[2])
        return low, out.upper() if found.isupper() else out

    def phone(self, found: str) -> tuple[str, str]:
        """Canonical: all digits with the country code, without a bracketed trunk zero; ten digits without a code are of country 1."""
        plain = found.replace("(0)", "()") if found.startswith("+") else found
        digits = re.sub(r"\D", "", plain)
        code = country_code(digits) if found.startswith("+") else ""
        rest = digits[len(code) :]
        made = permuted(self.key, f"phone{code or '1'}", rest, _places(rest))
        out = _digits_like(plain, code + made)
        return f"+{code or '1'}{rest}", out if plain == found else out.replace("()", "(0)")

    def card(self, found: str) -> tuple[str, str]:
        digits = re.sub(r"\D", "", found)
        status = luhn(digits)
        return digits, _digits_like(found, permuted(self.key, "card", digits, _places(digits), lambda d: luhn(d) == status))

    def ssn(self, found: str) -> tuple[str, str]:
        low = found.replace(" ", "-")
        made = permuted(self.key, "ssn", low, _places(low))
        return low, made if low == found else made.replace("-", " ")

    def iban(self, found: str) -> tuple[str, str]:
        flat = found.replace(" ", "")
        low = flat[4:].lower()
        made = permuted(self.key, "iban" + flat[:2], low, _places(low, _WHOLE)).upper()
        it = iter(flat[:2] + _iban_check(flat[:2], made) + made)
        return flat, "".join(c if c == " " else next(it) for c in found)

    def secret(self, found: str) -> tuple[str, str]:
        low = found.lower() if re.fullmatch("[0-9a-f]+|[0-9A-F]+", found) else ""
        if low:
            return low, _recased(found, permuted(self.key, "hex", low, [_HEX] * len(low))) if not found.isupper() else permuted(self.key, "hex", low, [_HEX] * len(low)).upper()
        upper = _WHOLE.upper()
        return found, permuted(self.key, "secret", found, [_WHOLE if c in _WHOLE else upper if c in upper else "0123456789" if c in "0123456789" else "" for c in found])

    def _one_name(self, word: str) -> str:
        low, script = _low(word), script_of(word)
        # a listed word stays in its list wherever it stands: the walk below skips listed values, so none may start from one
        if listed := _LISTED.get(low):
            names = NAMES[listed]
            at = [n.lower() for n in names].index(low)
            return names[_permutation(self.key, f"name{listed}", len(names)).step(at)]
        places = _places(low)
        if len([p for p in places if p]) > 2:
            places[-1] = ""
        return _recased(word, permuted(self.key, f"name {script}", low, places, lambda x: x not in _LISTED))

    def name(self, found: str) -> tuple[str, str]:
        """A name's surrogate, whatever the form of address before it."""
        if found[0] in HAN["s"]:
            kinds = ["s", *(next((k for k in "fm" if c in HAN[k]), "") for c in found[1:])]
            made = [permuted(self.key, f"han {k}", c, [HAN[k] if k else _HAN], lambda x, k=k: bool(k) or x not in HAN["f"] + HAN["m"]) for c, k in zip(found, kinds, strict=True)]
            return found, "".join(made)
        return _low(found), " ".join(map(self._one_name, found.split(" ")))

    def _names(self, text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int, str, str, str]]:
        """Names outside the places taken, and later mentions of their words."""
        spans = [m.span(m.lastgroup) for p in (_NAMED, _HAN_NAMED, _ARABIC_NAMED) for m in p.finditer(text) if m.lastgroup]
        spans = [(a, b) for a, b in spans if not any(x < b and a < y for x, y in taken)]
        if not spans:
            return []
        known = {text[a:b] for a, b in spans}
        words = sorted({w for n in known if n[0] not in HAN["s"] for w in n.split(" ") if len(w) > 2} | {n for n in known if n[0] in HAN["s"]}, key=lambda w: (-len(w), w))
        again = re.compile("|".join(re.escape(w) if w[0] in HAN["s"] else rf"\b{re.escape(w)}\b" for w in words)) if words else None
        held, out = sorted({*taken, *spans}), []
        for m in again.finditer(text) if again else ():
            k = bisect.bisect_right(held, (m.start(), math.inf))
            if not (k and held[k - 1][1] > m.start()) and not (k < len(held) and held[k][0] < m.end()):
                spans.append(m.span())
        at = -1
        for a, b in sorted(set(spans)):
            if a >= at:
                out.append((a, b, "name", *self.name(text[a:b])))
                at = b
        return out

    def _marked(self, text: str, found: list[tuple[int, int, str, str, str]]) -> list[tuple[int, int, str, str, str]]:
        """found, with IPv6 addresses, spaced social security numbers and assigned secrets outside of it."""
        more = []
        if text.count(":") > 1:
            for m in _IPV6.finditer(text):
                groups = [g for g in m[0].split(":") if g]
                if len(groups) > 2 and len("".join(groups)) > 4 and _ANY_DIGIT.search(m[0]) and _is_ipv6(m[0]):
                    more.append((*m.span(), "ip", *self.ipv6(m[0])))
        more += [(*m.span(1), "ssn", *self.ssn(m[1])) for m in _SPACED_SSN.finditer(text)]
        for m in _ASSIGNED.finditer(text):
            if _SECRET_NAME.search(text, max(0, m.start() - 60), m.start()) and looks_random(m[1]):
                more.append((*m.span(1), "secret", *self.secret(m[1])))
        if not more:
            return found
        out: list[tuple[int, int, str, str, str]] = []
        for e in sorted([*found, *more], key=lambda e: (e[0], -e[1])):
            if not out or e[0] >= out[-1][1]:
                out.append(e)
        return out

    def replaced(self, text: str) -> tuple[str, list[tuple[str, str, str]]]:
        """text with surrogates, and (kind, canonical form, surrogate) of each entity in order of place."""
        found: list[tuple[int, int, str, str, str]] = []
        if _ANY_DIGIT.search(text) or "@" in text or '"' in text or "'" in text:
            for m in _WITH_DIGITS.finditer(text):
                kind, value = m.lastgroup, m[0]
                if kind == "iban" and (flat := value.replace(" ", ""))[2:4] != _iban_check(flat[:2], flat[4:]):
                    continue
                if kind == "card" and value.isdigit() and len(value) != 16 and not luhn(value):
                    continue  # a long number that is no card
                if kind == "secret" and not (re.search(r"\d", value) and re.search(r"[A-Za-z]", value)):
                    continue
                found.append((*m.span(), kind, *getattr(self, kind)(value)))
        found = self._marked(text, found)
        found += self._names(text, [(a, b) for a, b, *_ in found])
        if not found:
            return text, []
        found.sort()
        out, at = [], 0
        for a, b, _, _, made in found:
            out += [text[at:a], made]
            at = b
        return "".join([*out, text[at:]]), [(k, c, s) for _, _, k, c, s in found]


_ANY_DIGIT = re.compile(r"\d")
_ENTITIES = pa.list_(pa.struct([("kind", pa.string()), ("canonical", pa.string()), ("surrogate", pa.string())]))


def digest(key: bytes, canonical: str) -> str:
    """Stands for a canonical form where the form itself must not be stored."""
    return hashlib.blake2b(canonical.encode(), key=hashlib.sha256(key).digest(), digest_size=16).hexdigest()


def surrogated(docs: DataFrame, key: bytes, entities: str | None = None, originals: bool = False) -> DataFrame:
    """docs with surrogates in text (n_chars follows); entities names a further column for (kind, canonical, surrogate).

    There, canonical is a keyed digest; with originals it is the form itself, for checks inside the trusted zone."""
    own = docs.columns
    rest = F.struct(*[F.col(f"`{c}`") for c in own if c != "text"] or [F.lit(0).alias("none")]).alias("_rest")
    rows = docs.select(rest, F.col("text").cast("string").alias("text"))
    empty = F.array().cast("array<struct<kind:string,canonical:string,surrogate:string>>")
    schema = rows.select("_rest", "text", empty.alias("_found")).schema

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replace = Surrogates(key).replaced
        for b in batches:
            texts, found = [], []
            for t in b.column(1):
                text, these = replace(t.as_py()) if t.is_valid else (None, [])
                texts.append(text)
                found.append([{"kind": k, "canonical": c if originals else digest(key, c), "surrogate": s} for k, c, s in these])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(found, _ENTITIES)], names=["_rest", "text", "_found"])

    out = rows.mapInArrow(made, schema)
    put = {"text": F.col("text")} | ({"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in own else {})
    columns = [(put[c] if c in put else F.col(f"_rest.`{c}`")).alias(c) for c in own]
    return out.select(*columns, *([F.col("_found").alias(entities)] if entities else []))


def collisions(found: DataFrame, entities: str = "entities") -> DataFrame:
    """(kind, surrogate, n): surrogates that stand for more than one canonical form; empty if all is well."""
    told = F.when(F.col("e.kind") == "secret", F.col("e.surrogate")).otherwise(F.lower("e.surrogate"))  # case tells secrets apart
    each = found.select(F.explode(entities).alias("e")).select("e.kind", told.alias("surrogate"), "e.canonical")
    # phone, card and IBAN formats differ in separators only
    flat = F.when(F.col("kind").isin("phone", "card", "iban"), F.regexp_replace("surrogate", r"[^0-9a-z+]", "")).otherwise(F.col("surrogate"))
    return each.withColumn("surrogate", flat).distinct().groupBy("kind", "surrogate").agg(F.count("canonical").alias("n")).filter("n > 1")


def drawn_key(key: bytes, draw: int) -> bytes:
    """The key of a draw: the key itself at first, derived from it and the draw's number afterwards."""
    return key if not draw else hashlib.blake2b(draw.to_bytes(4, "big"), key=hashlib.sha256(key).digest(), digest_size=32).digest()


def distinct_surrogates(docs: DataFrame, key: bytes, entities: str | None = None, draws: int = 8) -> DataFrame:
    """surrogated under the first drawn key by which no two entities of the corpus share a surrogate."""
    held = entities or "_entities_of_" + "_".join(docs.columns)
    for draw in range(draws):
        out = stored(surrogated(docs, drawn_key(key, draw), held), f"surrogates{draw}")
        if collisions(out, held).isEmpty():
            return out if entities else out.drop(held)
    raise ValueError(f"entities share a surrogate under each of {draws} keys")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = distinct_surrogates(documents(spark, sf_dir).select("doc_id", "text"), EXAMPLE_KEY, entities="entities")
    counts = [F.expr(f"cast(size(filter(entities, e -> e.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", F.size("entities").cast("long").alias("n_entities"), *counts, "text")
