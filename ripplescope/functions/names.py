"""Names of tests and types, escapes, durations and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The form of a test's full name, and endings of files that a listing can name.
FULL_NAME = r"^[A-Za-z_][A-Za-z0-9_.+`<>]*\z"
FILE_LIKE = r"(?i)\.(dll|exe|cs|csproj|trx|json|xml)\z"


def strip_args(name: Column) -> Column:
    """Without the arguments of a parameterised case."""
    return F.regexp_replace(name, r"(?s)\(.*\)\z", "")


def trimmed(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+\z", "")


def is_full_name(name: Column) -> Column:
    """Names with generic arguments and nested types count, files don't."""
    return name.rlike(FULL_NAME) & ~name.rlike(FILE_LIKE)


def class_of_listed(name: Column) -> Column:
    """Class of a listed test: arguments go, then what follows the last dot; null where what is left is no full name."""
    cut = F.regexp_extract(strip_args(name), r"(?s)^(.+)\.[^.]*\z", 1)
    return F.when(cut.rlike(FULL_NAME), cut)


def class_of_run(name: Column) -> Column:
    """Class of a name that ran: what stands before the last dot outside of parentheses, or all of it; one that closes too many opens none."""
    step = lambda a, c: F.struct(
        (a["at"] + 1).alias("at"),
        F.greatest(F.lit(0), a["depth"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)).alias("depth"),
        F.when((c == ".") & (a["depth"] == 0), a["at"]).otherwise(a["dot"]).alias("dot"),
    )
    found = F.aggregate(F.split(name, ""), F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(-1).alias("dot")), step, lambda a: a["dot"])
    return F.when(found > 0, F.substr(name, F.lit(1), found)).otherwise(name)


def class_of_method(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]+$", "")


def strip_nesting(name: Column) -> Column:
    """``Ns.Outer+Inner`` as ``Ns.Inner``."""
    inner = F.substring_index(name, "+", -1)
    space = F.regexp_extract(F.substring_index(name, "+", 1), r"^(.*\.)[^.]+$", 1)
    return F.when(F.contains(name, F.lit("+")), F.concat(space, inner)).otherwise(name)


def short_name(name: Column) -> Column:
    return F.regexp_replace(F.substring_index(F.substring_index(name, ".", -1), "+", -1), r"`\d+$", "")


def top_level(name: Column) -> Column:
    return F.substring_index(name, "+", 1)


def bare_name(name: Column) -> Column:
    """Without generic arguments or arity."""
    return F.regexp_replace(F.regexp_replace(name, r"<.*>$", ""), r"`\d+$", "")


def decode_entities(text: Column) -> Column:
    """The five XML entities, the ampersand last, so that nothing is decoded twice."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def encode_entities(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def escape_regex(text: Column) -> Column:
    return F.regexp_replace(text, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def escape_filter(text: Column) -> Column:
    return F.regexp_replace(text, r"([()&|=!~])", r"\\$1")


def class_filter(classes: Column) -> Column:
    """The text of a filter that runs the classes, in their order, and what is nested in them."""
    each = F.transform(classes, lambda c: F.concat(F.lit("FullyQualifiedName~"), escape_filter(c), F.lit(".|FullyQualifiedName~"), escape_filter(c), F.lit("+")))
    return F.array_join(each, "|")


def selected_by(method: Column, cls: Column) -> Column:
    """Whether a method belongs to a class or to what is nested in it; both edges are anchored."""
    return F.startswith(method, F.concat(cls, F.lit("."))) | F.startswith(method, F.concat(cls, F.lit("+")))


def duration_ms(text: Column) -> Column:
    """``h:m:s.f`` in milliseconds; 0 where it is malformed."""
    part = lambda i: F.regexp_extract(text, r"^(\d+):(\d+):(\d+(?:\.\d+)?)$", i).try_cast("double")
    return F.coalesce((part(1) * 3600 + part(2) * 60 + part(3)) * 1000, F.lit(0.0))


def stamp_newest_ms(stamp: Column) -> Column:
    """Second field of a stamp; infinity where it can't be read."""
    return F.coalesce(F.try_element_at(F.split(stamp, ":"), F.lit(2)).try_cast("double"), F.lit(float("inf")))


def polynomial_hash(text: Column) -> Column:
    """31-polynomial hash in 32 signed bits, over characters of the basic plane."""
    wrap = lambda x: F.pmod(x + F.lit(2**31), F.lit(2**32)) - F.lit(2**31)
    return F.when(F.length(text) == 0, F.lit(0).cast("long")).otherwise(F.aggregate(F.split(text, ""), F.lit(0).cast("long"), lambda h, c: wrap(h * 31 + F.ascii(c))))


def cache_key(path: Column) -> Column:
    return F.substr(F.sha1(F.lower(path)), F.lit(1), F.lit(12))


def reply_kind(code: Column) -> Column:
    return F.when(code == 1, "applied").when(code == 2, "not-loaded").otherwise("rejected")


def words(text: Column) -> Column:
    """Distinct identifier words: runs of letters, decimal digits and underscores."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{Nd}_]+"), F.lit(0)))


# Names as written, and the calls that register a service with its implementation.
_NAME = r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*(?:<[^<>]*>)?"
_GAP = r"[\s\p{Z}]*"
_TWO_NAMES = rf"\b(?:Try)?(?:AddScoped|AddSingleton|AddTransient|RegisterType){_GAP}<{_GAP}({_NAME}){_GAP},{_GAP}({_NAME}){_GAP}>"
_ONE_NAME_NEW = rf"\b(?:AddScoped|AddSingleton|AddTransient){_GAP}<{_GAP}({_NAME}){_GAP}>{_GAP}\({_GAP}new[\s\p{{Z}}]+({_NAME}){_GAP}[({{]"


def registrations(text: Column) -> Column:
    """Pairs (service, impl) that a source registers, each once, without pairs of one name.

    They are told apart as strings, as Spark compares each struct with all others.
    No name has ``<<`` in it or ends with ``<``.
    """
    pairs = []
    for rx in (_TWO_NAMES, _ONE_NAME_NEW):
        services, impls = (F.regexp_extract_all(text, F.lit(rx), F.lit(i)) for i in (1, 2))
        pairs.append(F.zip_with(services, impls, lambda s, i: F.when(s != i, F.concat(s, F.lit("<<"), i))))
    side = lambda p, i: F.get(F.split(p, "<<"), F.lit(i))
    return F.transform(F.array_distinct(F.array_compact(F.concat(*pairs))), lambda p: F.struct(side(p, 0).alias("service"), side(p, 1).alias("impl")))


# Attributes that mark a method as a test.
TEST_ATTRIBUTES = ["FactAttribute", "TheoryAttribute", "TestAttribute", "TestCaseAttribute", "TestMethodAttribute", "DataTestMethodAttribute"]


def is_test_class(fqn: Column, attributes: Column, in_test_assembly: Column) -> Column:
    """Whether a type's methods carry a test attribute, in an assembly of tests; what a compiler made is none."""
    return in_test_assembly & F.arrays_overlap(attributes, F.array(*map(F.lit, TEST_ATTRIBUTES))) & ~F.contains(fqn, F.lit("<"))
