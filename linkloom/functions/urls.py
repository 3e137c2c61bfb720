"""URLs as Column expressions: parts, host, canonical form, joining, registered domain. No UDF is needed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)"
#: Second labels under which the registries of these countries give out names.
_SECOND = {
    "uk": "ac co gov ltd me net nhs org plc police sch", "au": "asn com edu gov id net org", "nz": "ac co cri geek gen govt health iwi kiwi maori mil net org parliament school", "jp": "ac ad co ed go gr lg ne or",
    "br": "adm adv agr art blog com eco edu emp eng esp etc far flog fst gov ind inf jus leg mil net org pro psi rec tur tv vet wiki", "mx": "com edu gob net org", "ar": "com edu gob gov int mil net org tur", "tr": "av bbs bel biz com dr edu gen gov info k12 kep mil name net org pol tel tv web",
    "cn": "ac com edu gov mil net org", "hk": "com edu gov idv net org", "tw": "club com ebiz edu game gov idv mil net org", "kr": "ac co es go hs kg mil ms ne or pe re sc", "in": "ac co edu firm gen gov ind info mil net nic org res", "za": "ac agric alt co edu gov grondar law mil net ngo nic nis nom org school tm web",
    "sg": "com edu gov net org per", "my": "biz com edu gov mil name net org", "id": "ac biz co desa go mil my net or ponpes sch web", "il": "ac co gov idf k12 muni net org", "ua": "com edu gov in net org kiev kyiv lviv odessa kharkov dp", "pl": "aid agro atm auto biz com edu gmina gov gsm info mail media miasta mil net nieruchomosci nom org pc powiat priv realestate rel sex shop sklep sos szkola targi tm tourism travel turystyka waw",
    "ru": "", "es": "com edu gob nom org", "pt": "com edu gov int net nome org publ", "th": "ac co go in mi net or", "vn": "ac biz com edu gov health info int name net org pro", "ph": "com edu gov i mil net ngo org", "pk": "biz com edu fam gob gok gon gop gos gov info net org web", "bd": "ac com edu gov info mil net org",
    "eg": "com edu eun gov mil name net org sci", "ng": "com edu gov i mil mobi name net org sch", "ke": "ac co go info me mobi ne or sc", "gr": "com edu gov net org", "cy": "ac biz com ekloges gov ltd mil net org press pro tm", "at": "ac co gv or", "hu": "2000 agrar bolt casino city co erotica erotika film forum games hotel info ingatlan jogasz konyvelo lakas media news org priv reklam sex shop sport suli szex tm tozsde utazas video",
    "ro": "arts com firm info nom nt org rec store tm www", "rs": "ac co edu gov in org", "hr": "com from iz name", "si": "", "it": "edu gov", "fr": "asso avoues cci com gouv greta huissier-justice nom prd tm", "ve": "arts bib co com e12 edu firm gob gov info int mil net nom org rar rec store tec web", "pe": "com edu gob mil net nom org", "co": "com edu gov mil net nom org",
    "ec": "com edu fin gob gov info k12 med mil net org pro", "bo": "academia com edu gob int mil net org tv web", "py": "com coop edu gov mil net org", "uy": "com edu gub mil net org", "cr": "ac co ed fi go or sa", "do": "art com edu gob gov mil net org sld web", "gt": "com edu gob ind mil net org", "sa": "com edu gov med net org pub sch", "ae": "ac co gov mil net org sch",
    "qa": "com edu gov mil name net org sch", "kw": "com edu emb gov ind net org", "ir": "ac co gov id net org sch", "lk": "ac assn com edu gov grp hotel int ltd net ngo org sch soc web", "np": "com edu gov mil net org", "ma": "ac co gov net org press", "tn": "com ens fin gov ind info intl mincom nat net org perso tourism", "gh": "com edu gov mil org", "tz": "ac co go hotel info me mil mobi ne or sc tv",
    "ug": "ac co com go ne or org sc", "zm": "ac biz co com edu gov info mil net org sch", "zw": "ac co gov mil org", "by": "com gov mil of", "kz": "com edu gov mil net org", "uz": "co com net org", "ge": "com edu gov mil net org pvt", "az": "biz com edu gov info int mil name net org pp pro", "mt": "com edu net org", "im": "ac co com net org tt tv",
}
#: Public suffixes of more than one label; every other last label counts as a suffix of its own. ``suffix_list`` reads others.
SUFFIXES = tuple(f"{x}.{country}" for country, own in _SECOND.items() for x in own.split())
#: Last labels that are no public suffix: a name under them has none, and its last label is its own domain.
PRIVATE = ("example", "test", "invalid", "localhost", "local", "internal")
HOME_PATHS = ("", "/", "/index.html", "/index.htm", "/default.htm", "/default.html")


def part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _PARTS, group)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def netloc(url: Column) -> Column:
    return part(url, 2)


def path(url: Column) -> Column:
    """The path up to any ``;`` of its last segment."""
    return F.regexp_replace(part(url, 3), r";[^/]*$", "")


def params(url: Column) -> Column:
    """What follows ``;`` in the last segment of the path."""
    return F.regexp_extract(part(url, 3), r";([^/]*)$", 1)


def query(url: Column) -> Column:
    return part(url, 4)


def fragment(url: Column) -> Column:
    return part(url, 5)


def parts(url: Column) -> Column:
    """scheme, netloc, path, params, query, fragment; empty where the URL has none."""
    return F.struct(scheme(url).alias("scheme"), netloc(url).alias("netloc"), path(url).alias("path"), params(url).alias("params"), query(url).alias("query"), fragment(url).alias("fragment"))


def host(url: Column) -> Column:
    """The lower-case host name; null without one. Accepts ``_`` and non-ASCII names, drops user and port."""
    found = F.lower(F.regexp_extract(url, _HOST, 1))
    return F.when(found != "", found)


def _escaped(text: Column, plus: bool = False) -> Column:
    """Percent escapes in one spelling: upper-case digits, unreserved characters plain, others than printable ASCII escaped.
    ``plus``: as in queries, where a blank is ``+``."""

    def one(x: Column) -> Column:
        code = F.upper(F.substring(x, 1, 2))
        char = F.char(F.conv(code, 16, 10).cast("bigint"))
        rest = F.substr(x, F.lit(3))
        free = F.when(char.rlike(r"^[A-Za-z0-9._~-]$"), char).otherwise(F.concat(F.lit("%"), code))
        return F.when(x.rlike("^[0-9A-Fa-f]{2}"), F.concat(free, rest)).otherwise(F.concat(F.lit("%25"), x))

    pieces = F.split(text, "%")
    known = F.when(text.contains("%"), F.concat(F.element_at(pieces, 1), F.array_join(F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), one), ""))).otherwise(text)
    odd = lambda c: F.when(c.rlike(r"[^\x21-\x7e]"), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))).otherwise(c)
    whole = F.when(known.rlike(r"[^\x21-\x7e]"), F.array_join(F.transform(F.split(known, ""), odd), "")).otherwise(known)
    return F.replace(whole, F.lit("%20"), F.lit("+")) if plus else whole


def canonical(url: Column) -> Column:
    """Scheme and host in lower case, ``/`` for an empty path, percent escapes in one spelling, the pairs of the query sorted by
    key and value, fragment dropped."""
    pairs = F.transform(F.split(query(url), "&"), lambda p: F.struct(_escaped(F.substring_index(p, "=", 1), True).alias("k"), _escaped(F.regexp_replace(p, "^[^=]*", ""), True).alias("v")))
    sorted_ = F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat(p["k"], p["v"])), "&")
    full = _escaped(part(url, 3))
    return F.concat(
        F.when(scheme(url) != "", F.concat(scheme(url), F.lit(":"))).otherwise(F.lit("")),
        F.when(netloc(url) != "", F.concat(F.lit("//"), F.lower(netloc(url)))).otherwise(F.lit("")),
        F.when((full == "") & (netloc(url) != ""), F.lit("/")).otherwise(full),
        F.when(query(url) != "", F.concat(F.lit("?"), sorted_)).otherwise(F.lit("")),
    )


def _resolved(segments: Column) -> Column:
    """A path of its segments, without ``.`` and with each ``..`` taking away the one before."""
    stack = F.aggregate(
        segments, F.array().cast("array<string>"),
        lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == ".", acc).otherwise(F.array_append(acc, x)),
    )
    open_ = F.when(F.element_at(segments, -1).isin(".", ".."), F.array_append(stack, F.lit(""))).otherwise(stack)
    path = F.array_join(open_, "/")
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))


def join(base: Column, link: Column) -> Column:
    """``link`` as seen from the page ``base``: absolute, ``//host``, ``/path``, ``?query``, ``#fragment`` or relative; ``.`` and
    ``..`` in paths are resolved, and never lead above the root."""
    root = F.concat(scheme(base), F.lit("://"), netloc(base))
    own = F.regexp_extract(link, r"^([^?#]*)", 1)
    rest = F.regexp_replace(F.substr(link, F.length(own) + 1), r"^\?(?=#|$)|#$", "")
    there = F.when(part(base, 3) == "", F.lit("/")).otherwise(part(base, 3))
    folder = F.split(F.regexp_replace(there, r"/[^/]*$", ""), "/")
    steps = F.split(own, "/")
    between = F.filter(F.concat(F.slice(folder, 2, F.size(folder)), F.slice(steps, 1, F.size(steps) - 1)), lambda x: x != "")
    relative = F.concat(F.array(F.lit("")), between, F.slice(steps, -1, 1))
    asked = F.when(query(base) != "", F.concat(F.lit("?"), query(base))).otherwise("")
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme(base), F.lit(":"), link))
        .when(link == "", base)
        .when(own.startswith("/"), F.concat(root, _resolved(steps), rest))
        .when((own == "") & rest.startswith("?"), F.concat(root, part(base, 3), rest))
        .when(own == "", F.concat(root, part(base, 3), asked, rest))
        .otherwise(F.concat(root, _resolved(relative), rest))
    )


def suffix_list(lines: list[str]) -> tuple[str, ...]:
    """The suffixes of more than one label of a public suffix list (a rule a line, ``//`` before comments; ``*.x`` and ``!x``
    aren't read), for ``suffix`` and ``registered_domain``."""
    return tuple(x for x in (line.strip().lower() for line in lines) if x and "." in x and not x.startswith(("//", "*", "!")))


def _length(name: Column, suffixes: tuple[str, ...]) -> Column:
    """How many labels the public suffix of a host name has."""
    found = F.when(name.contains(".") & ~F.substring_index(name, ".", -1).isin(*PRIVATE), 1).otherwise(0)
    for n in sorted({x.count(".") + 1 for x in suffixes}):
        found = F.when(F.substring_index(name, ".", -n).isin(*(x for x in suffixes if x.count(".") + 1 == n)) & (F.size(F.split(name, "\\.")) >= n), n).otherwise(found)
    return found


def _last(name: Column, n: Column) -> Column:
    labels = F.split(name, "\\.")
    return F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), F.greatest(n, F.lit(0))), ".")


def suffix(name: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The public suffix of a host name; empty for a name of one label, under a private one, and for a suffix itself."""
    n = _length(name, suffixes)
    return F.when(F.size(F.split(name, "\\.")) == n, F.when(n > 1, F.substring_index(name, ".", -1)).otherwise("")).otherwise(_last(name, n))


def registered_domain(name: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The label before the public suffix, with the suffix; the last label alone where there is no suffix."""
    return _last(name, _length(name, suffixes) + 1)


def is_home(url: Column) -> Column:
    """No query, and a path of a home page."""
    return (query(url) == "") & path(url).isin(*HOME_PATHS)
