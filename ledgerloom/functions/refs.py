"""References, card numbers, counterparties, untrusted text: string expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of a bank reference, labelled and bare; separators; card runs.
LABELLED = r"(?:UTR|RRN|REF|TXN)(?:\s*NO)?[\s:.\-]*([A-Z]*[0-9][A-Z0-9]{7,21})"
BARE = r"\b([A-Z]{2,6}[0-9][A-Z0-9]{7,18})\b"
CARD = r"((?:\d[ \-]?){13,19})"
#: Channel prefixes in the order in which they are stripped, and words that carry no identity.
CHANNELS = ["neft cr ", "neft dr ", "rtgs cr ", "rtgs dr ", "imps ", "upi ", "ach ", "to ", "from "]
NOISE = "pvt private ltd limited llp inc incorporated corp corporation co company plc opc and the ms mss pte gmbh sa sarl bv".split()
#: What an attempt to steer a reader of the text looks like.
INJECTIONS = [
    r"(ignore|disregard|forget|override)\s+(all\s+|the\s+)?(previous|prior|above|earlier|these|any)\s+(instructions?|rules?|prompts?|context|messages?|directives?)",
    r"disregard\s+(the\s+)?(system|previous|above)",
    r"you\s+are\s+(now|actually|really)\s+",
    r"\bnew\s+(instructions?|task|role|system\s+prompt)\b",
    r"\b(mark|treat|set|flag|consider)\b.{0,30}\b(as\s+)?(reconciled|resolved|matched|verified|approved|complete|done|clean)\b",
    r"\bapprove\s+(this|all|every|the)\b",
    r"\byou\s+are\s+authori[sz]ed\s+to\b",
    r"</?(system|assistant|user|untrusted[- ]record[- ]data)>",
    r"(?m)^\s{0,4}(system|assistant|developer)\s*[:>]",
    r"\bprompt\s*injection\b",
    "[\\x{202A}-\\x{202E}\\x{2066}-\\x{2069}]",
]


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def extract_utr(text: Column | str) -> Column:
    """A labelled reference, else a bare token of letters then digits; null without one."""
    up = F.upper(_c(text))
    return F.coalesce(F.nullif(F.regexp_extract(up, LABELLED, 1), F.lit("")), F.nullif(F.regexp_extract(up, BARE, 1), F.lit("")))


def normalize_reference(text: Column | str) -> Column:
    return F.nullif(F.upper(F.trim(F.regexp_replace(_c(text), r"\s+", " "))), F.lit(""))


def luhn_ok(text: Column | str) -> Column:
    """Thirteen to nineteen digits (blanks and dashes aside) that pass the Luhn test."""
    digits = F.regexp_replace(_c(text), r"[ \-]", "")
    return F.coalesce(F.regexp_like(digits, F.lit(r"^\d{13,19}$")) & F.call_function("luhn_check", digits), F.lit(False))


def card_runs(text: Column | str) -> Column:
    """The card-shaped runs of a text that pass the Luhn test."""
    return F.filter(F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(CARD), 1), lambda r: luhn_ok(r))


def scrub_cards(text: Column | str) -> Column:
    """Card numbers give way to their last four digits."""
    mask = lambda r: F.concat(F.lit("[card ****"), F.right(F.regexp_replace(r, r"[ \-]", ""), F.lit(4)), F.lit("]"))
    return F.when(_c(text).isNotNull(), F.aggregate(card_runs(text), _c(text), lambda t, r: F.replace(t, r, mask(r))))


def neutralize(text: Column | str) -> Column:
    """A cell that a spreadsheet would run as a formula gets a quote in front."""
    return F.when(F.regexp_like(_c(text), F.lit(r"^[=+\-@]")), F.concat(F.lit("'"), _c(text))).otherwise(_c(text))


def entity_tokens(name: Column | str) -> Column:
    s = F.lower(F.trim(F.coalesce(_c(name), F.lit(""))))
    for p in CHANNELS:
        s = F.regexp_replace(s, f"^{p}", "")
    s = F.replace(F.replace(s, F.lit("&"), F.lit(" and ")), F.lit("/"), F.lit(" "))
    return F.filter(F.regexp_extract_all(s, F.lit("([a-z0-9]+)"), 1), lambda t: ~t.isin(NOISE) & ~F.regexp_like(t, F.lit(r"^[0-9]+$")) & (F.length(t) > 1))


def canonical_entity(name: Column | str) -> Column:
    """A comparable key for a counterparty; empty for no name."""
    return F.array_join(entity_tokens(name), " ")


def same_entity(a: Column | str, b: Column | str) -> Column:
    """Keys are equal or the words of one are among those of the other."""
    ta, tb = entity_tokens(a), entity_tokens(b)
    return (F.size(ta) > 0) & (F.size(tb) > 0) & ((F.size(F.array_except(ta, tb)) == 0) | (F.size(F.array_except(tb, ta)) == 0))


def injection_index(text: Column | str) -> Column:
    """Number (from 1) of the first pattern that the text matches; null when none does."""
    out = F.lit(None).cast("int")
    for k in range(len(INJECTIONS), 0, -1):
        out = F.when(F.regexp_like(_c(text), F.lit("(?i)" + INJECTIONS[k - 1])), k).otherwise(out)
    return out


def tokens(text: Column | str, least: int = 3) -> Column:
    """Upper-case runs of letters and digits of at least ``least`` characters."""
    return F.filter(F.split(F.upper(F.coalesce(_c(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) >= least)


def html_escape(text: Column | str) -> Column:
    s = _c(text)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        s = F.replace(s, F.lit(raw), F.lit(safe))
    return s


def mask_account(text: Column | str) -> Column:
    """All but the last four characters are masked."""
    s = _c(text)
    return F.when(F.length(s) <= 4, F.repeat(F.lit("X"), 4)).otherwise(F.concat(F.repeat(F.lit("X"), F.length(s) - 4), F.right(s, F.lit(4))))
