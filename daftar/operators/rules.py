"""Ordered rules over columns: first match, all matches, sums of scores; and the catalog's rule packs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import packs
from ..functions.normalize import DIWAN, REFINE, THESIS, UPLOAD, normalize
from ..functions.regexjs import js
from ..functions.text import EDITION, arabic_text, arabic_title, clean_catalog_title, clean_person, clean_title, has_word, replace_all, squeeze, test
from .filters import all_arabic_languages, any_other_language, arabic_proof, is_archive_details, part_of_collection, record_is_arabic, referenced_title


@dataclass(frozen=True)
class Rule:
    """A condition with what it means: a reason, a tag or a score."""

    condition: Column
    value: object


def first_match(rules: Sequence[Rule], otherwise=None) -> Column:
    """The value of the first rule that holds."""
    return F.coalesce(*(F.when(r.condition, F.lit(r.value)) for r in rules), F.lit(otherwise))


def all_matches(rules: Sequence[Rule]) -> Column:
    """Distinct values of all rules that hold, in order."""
    return F.array_distinct(F.array_compact(F.array(*(F.when(r.condition, F.lit(r.value)) for r in rules))))


def score(rules: Sequence[Rule]) -> Column:
    out = F.lit(0)
    for r in rules:
        out = out + F.when(r.condition, F.lit(r.value)).otherwise(F.lit(0))
    return out


# --- fixed values: tags and reasons ---
DICTIONARY, RHETORIC, GRAMMAR, MORPHOLOGY, LINGUISTICS, LITERATURE, THESIS_TAG = "معجم لغوي", "بلاغة", "نحو", "صرف", "دراسات لغوية", "شعر وأدب", "رسالة علمية"
REASONS = {
    "incomplete": "بيانات العنوان أو معرّف أرشيف أو الرابط غير مكتملة",
    "failed": "تعذر جلب بيانات أرشيف",
    "not_arabic_title": "عنوان غير عربي أو لا يكفي لإثبات عربية المادة",
    "worksheet": "مادة مراجعة أو اختبار مدرسي وليست مرجعاً مناسباً للمكنز",
    "other_language": "حقل اللغة في أرشيف يثبت لغة غير عربية",
    "other_subject": "المادة تتصل بلغة غير عربية ولا تدخل ضمن نطاق المكنز",
    "other_dictionary": "معجم أو مرجع متخصص خارج علوم العربية ولا يمثل قسماً من أقسام المكنز",
    "not_prosody": "تستعمل كلمة العروض في سياق مسرحي أو تجاري أو فقهي لا يتصل بعروض الشعر",
    "no_evidence": "لا تثبت بيانات أرشيف أن المادة عربية",
    "off_topic": "لا يثبت العنوان والبيانات صلة المادة بأحد أقسام علوم العربية في المكنز",
}
DIWAN_REASONS = ("عنوان مفقود", "عنوان غير عربي", "لغة أو سياق غير عربي", "دراسة أو سجل غير ديواني", "مجموعة أو جزء غير مستقل", "البيانات لا تثبت أن السجل ديواناً مستقلاً")
EVIDENCE = ("العنوان يصرح بأن السجل ديوان", "البيانات الوصفية تثبت أن عنوان السجل ديوان مستقل", "البيانات الوصفية تربط عنوان السجل بمجموعة شعرية مستقلة")
MERGE_REASONS = ("العنوان ليس عربياً خالصاً", "لغة أو سياق غير عربي", "العنوان يصف مادة غير ديوانية أو عملاً مضمّناً", "لا يثبت شاعر أو ديوان مستقل")
REFINE_REASONS = ("عنوان فارغ بعد التنظيف", "دراسة أو سجل غير ديواني", "ضجيج تنزيل ظاهر")
COLLECTION = r"(?:ديوان\s+شعري|مجموعه\s+شعريه|مجموعه\s+من\s+القصائد|قصائد\s+الشاعر|اشعار\s+الشاعر|شعر\s+الشاعر)"
SHORT_GRAMMAR = r"^(?:أقسام الكلام|العوامل وهي قسمان لفظية ومعنوية|المعمولات وهي قسمان أسماء وأفعال مضارعة)$"
LEVELS = ("دكتوراه", "ماجستير", "رسالة علمية")
POET_AFTER, POET_BEFORE = r"^ديوان\s+(.+)", r"^(.{3,70}?)\s*(?:[:\-—–]\s*|\s+)ديوان\s+"


def any_of(text: Column, pack: dict, *names: str) -> Column:
    return test(text, ("|".join(f"(?:{pack[n][0]})" for n in names), "i"))


def lexical_dictionary(text: Column, pack=packs.LITERATURE) -> Column:
    """A known dictionary, or a cue with a context of language and none of other fields."""
    return test(text, pack["lexical_dictionary"]) | (test(text, pack["dictionary_cue"]) & test(text, pack["lexical_dictionary_context"]) & ~test(text, pack["non_language_dictionary"]))


def literature_tags(text: Column, pack=packs.LITERATURE) -> Column:
    rhetoric = test(text, pack["rhetoric"])
    return all_matches([
        Rule(lexical_dictionary(text, pack), DICTIONARY), Rule(rhetoric, RHETORIC), Rule(test(text, pack["grammar"]), GRAMMAR), Rule(test(text, pack["morphology"]), MORPHOLOGY),
        Rule(test(text, pack["linguistics"]) & ~rhetoric, LINGUISTICS), Rule(test(text, pack["literature"]), LITERATURE), Rule(test(text, pack["thesis"]), THESIS_TAG),
    ])


def subject_tags(text: Column, pack=packs.GRAMMAR) -> Column:
    """The grammar and rhetoric imports: literature only without a more precise tag."""
    dictionary, rhetoric, grammar, morphology = (test(text, pack[n]) for n in ("dictionary", "rhetoric", "grammar", "morphology"))
    return all_matches([
        Rule(dictionary, DICTIONARY), Rule(rhetoric, RHETORIC), Rule(grammar, GRAMMAR), Rule(morphology, MORPHOLOGY),
        Rule(test(text, pack["linguistics"]) & ~rhetoric, LINGUISTICS), Rule(test(text, pack["literature"]) & ~(dictionary | rhetoric | grammar | morphology), LITERATURE),
    ])


def with_fallback(tags: Column, subject: Column) -> Column:
    """Tags of the subject alone where the whole text gives none."""
    return F.when(F.size(tags) == 0, subject).otherwise(tags)


def _listed(key: Column, titles) -> Column:
    return key.isin(*titles) if titles else F.lit(False)


def list_tags(title: Column, key: Column, category: Column, keys: dict[str, str], relevant: Sequence[str], pack=packs.TITLES) -> Column:
    """Tags of a title list; ``keys`` maps canonical titles to manual tags, ``relevant`` lists canonical titles."""
    rules = [Rule(key == k, tag) for k, tag in keys.items()]
    rules += [
        Rule(test(title, pack["dictionary"]), DICTIONARY), Rule(test(title, pack["rhetoric"]), RHETORIC), Rule(test(title, pack["grammar"]), GRAMMAR), Rule(test(title, pack["morphology"]), MORPHOLOGY),
        Rule(test(title, pack["linguistics"]) | test(title, pack["education_language"]), LINGUISTICS), Rule(test(title, pack["literature"]), LITERATURE),
    ]
    tags = all_matches(rules)
    fallback = F.try_element_at(F.create_map(*(F.lit(x) for kv in packs.CATEGORY_TAG.items() for x in kv)), category)
    add = fallback.isNotNull() & ((F.size(tags) > 0) | _listed(key, [*keys, *relevant]))
    return F.when(add, F.array_distinct(F.array_append(tags, fallback))).otherwise(tags)


def list_relevant(title: Column, key: Column, category: Column, listed: Sequence[str], pack=packs.TITLES) -> Column:
    """Whether a title of a list belongs to the catalog's subjects."""
    vague = test(title, pack["vague_title"]) | test(key, pack["vague_title"])
    out = test(title, pack["explicit_exclusion"]) | test(key, pack["explicit_exclusion"]) | test(title, pack["non_language_context"])
    topics = any_of(title, pack, "rhetoric", "grammar", "morphology", "dictionary", "linguistics", "literature", "education_language")
    return F.when(vague | out, False).when(_listed(key, listed), True).when(topics, True).otherwise((category == "النحو والإعراب") & test(title, (SHORT_GRAMMAR, "i")))


def primary_category(tags: Column, theses: bool = True) -> Column:
    has = lambda t: F.array_contains(tags, t)
    rest = F.when(has(DICTIONARY), "dictionaries").otherwise("references")
    return F.when(has(THESIS_TAG), "academic_theses").otherwise(rest) if theses else rest


def _present(text: Column) -> Column:
    return F.coalesce(text != "", F.lit(False))


def literature_reason(c: dict[str, Column], pack=packs.LITERATURE) -> Column:
    """Why a book is not taken, or null. ``c``: title, raw_title, archive_title, identifier, url, error, language, subject, description, creator, tags."""
    titles = F.concat_ws(" ", c["title"], c["raw_title"], c["archive_title"], c["subject"])
    everything = F.concat_ws(" ", titles, c["description"], c["creator"])
    topic = any_of(titles, pack, "rhetoric", "grammar", "morphology", "dictionary_cue", "linguistics", "literature")
    other = (test(titles, pack["non_language_dictionary"]) | test(titles, pack["non_core_reference"])) & ~test(titles, pack["literary_biography"])
    proof = all_arabic_languages(c["language"]) | test(c["subject"], pack["arabic_language_text"]) | test(c["description"], pack["arabic_language_text"])
    return first_match([
        Rule(~(_present(c["raw_title"]) & _present(c["identifier"]) & is_archive_details(c["url"])), "incomplete"), Rule(c["error"].isNotNull(), "failed"), Rule(~arabic_title(c["title"]), "not_arabic_title"),
        Rule(test(F.concat_ws(" ", c["title"], c["raw_title"], c["subject"]), pack["educational_worksheet"]), "worksheet"), Rule(any_other_language(c["language"]), "other_language"),
        Rule(test(everything, pack["non_arabic_subject"]), "other_subject"), Rule(other, "other_dictionary"), Rule(test(F.replace(everything, F.lit("_"), F.lit(" ")), pack["non_prosody_arood"]), "not_prosody"),
        Rule(~proof, "no_evidence"), Rule((F.size(c["tags"]) == 0) | ~topic | test(everything, pack["excluded_topic"]), "off_topic"),
    ])


def subject_reason(c: dict[str, Column], pack, topic: str | None = None, forgiven: str | None = None) -> Column:
    """The grammar and rhetoric imports' cascade: no dictionary or prosody step, one topic, an exclusion that ``forgiven`` overrides."""
    titles = F.concat_ws(" ", c["title"], c["raw_title"])
    all_text = F.concat_ws(" ", titles, c["subject"], c["description"])
    everything = F.concat_ws(" ", all_text, c["creator"])
    on_topic = test(all_text, pack[topic]) if topic else any_of(all_text, pack, "rhetoric", "grammar", "morphology", "dictionary", "linguistics", "literature")
    excluded = test(everything, pack["excluded_topic"])
    if forgiven:
        excluded = excluded & ~test(all_text, pack[forgiven])
    proof = all_arabic_languages(c["language"]) | test(c["subject"], pack["arabic_language_text"]) | test(c["description"], pack["arabic_language_text"])
    rules = [
        Rule(~(_present(c["raw_title"]) & _present(c["identifier"]) & is_archive_details(c["url"])), "incomplete"), Rule(c["error"].isNotNull(), "failed"), Rule(~arabic_title(c["title"]), "not_arabic_title"),
        Rule(test(F.concat_ws(" ", titles, c["subject"]), pack["educational_worksheet"]), "worksheet"), Rule(any_other_language(c["language"]), "other_language"),
    ]
    if "non_arabic_subject" in pack:
        rules.append(Rule(test(everything, pack["non_arabic_subject"]), "other_subject"))
    return first_match([*rules, Rule(~proof, "no_evidence"), Rule((F.size(c["tags"]) == 0) | ~on_topic | excluded, "off_topic")])


def list_reason(title: Column, key: Column, category: Column, tags: Column, listed: Sequence[str]) -> Column:
    return first_match([Rule(key == "", "empty"), Rule(~arabic_title(title), "not_arabic_title"), Rule(~list_relevant(title, key, category, listed), "off_topic"), Rule(F.size(tags) == 0, "no_tag")])


def plausible_person(name: Column, pack=packs.DIWAN, generic: str = "generic_poet") -> Column:
    """A cleaned name that is Arabic, not generic and no word of studies."""
    person = clean_person(name)
    key = normalize(person, DIWAN)
    return (person != "") & arabic_text(person, foreign=pack["foreign_script"]) & ~test(key, pack[generic]) & ~test(key, pack["reject_title"])


def poet(title: Column, creator: Column, before: bool = True, pack=packs.DIWAN, generic: str = "generic_poet") -> Column:
    """The creator if plausible, else the name after the word diwan, else the name before it."""
    cleaned = clean_title(title)
    after = clean_person(replace_all(F.regexp_extract(cleaned, js(POET_AFTER), 1), (EDITION,)))
    words = lambda c: F.size(F.split(squeeze(c), " "))
    out = F.when(plausible_person(creator, pack, generic), clean_person(creator)).when(plausible_person(after, pack, generic) & (words(after) <= 5), after)
    if before:
        ahead = clean_person(F.regexp_extract(cleaned, js(POET_BEFORE), 1))
        out = out.when(plausible_person(ahead, pack, generic) & (words(ahead) <= 6), ahead)
    return out.otherwise("")


def diwan_evidence(title: Column, subject: Column, description: Column, creator: Column, pack=packs.DIWAN) -> Column:
    """What proves that a record is a diwan; empty if nothing does."""
    key, metadata = normalize(title, DIWAN), normalize(F.concat_ws(" ", subject, description), DIWAN)
    referenced = referenced_title(key, metadata)
    poetry = has_word(key, "قصائد") | has_word(key, "اشعار") | has_word(key, "شعر")
    return first_match([
        Rule(has_word(key, "ديوان"), EVIDENCE[0]), Rule(has_word(metadata, "ديوان") & referenced & poetry, EVIDENCE[1]),
        Rule(test(metadata, (COLLECTION, "")) & referenced & plausible_person(creator, pack) & poetry, EVIDENCE[2]),
    ], "")


def diwan_reason(title: Column, subject: Column, description: Column, evidence: Column, pack=packs.DIWAN) -> Column:
    """First reason against a diwan (v4, v5), null if it is eligible."""
    key, context = normalize(title, DIWAN), normalize(F.concat_ws(" ", subject, description), DIWAN)
    foreign = test(context, pack["foreign_language_signal"]) | test(key, pack["foreign_language_signal"])
    false = test(key, pack["reject_title"]) | test(key, pack["contextual_reject_title"])
    conditions = (title == "", ~arabic_text(title, foreign=pack["foreign_script"]), foreign, false, part_of_collection(key), evidence == "")
    return first_match([Rule(c, r) for c, r in zip(conditions, DIWAN_REASONS, strict=True)])


def upload_reason(identifier: Column, title: Column, subject: Column, description: Column, languages: Column, evidence: Column) -> Column:
    """The upload's cascade: also a missing identifier and unproven Arabic."""
    context = F.concat_ws(" ", subject, description)
    return first_match([
        Rule(F.coalesce(identifier, F.lit("")) == "", "معرّف مفقود"), Rule(title == "", DIWAN_REASONS[0]), Rule(~arabic_text(title, foreign=packs.UPLOAD["foreign_script"]), DIWAN_REASONS[1]),
        Rule(test(normalize(F.concat_ws(" ", title, context), UPLOAD), packs.UPLOAD["foreign_language_signal"]), DIWAN_REASONS[2]), Rule(~arabic_proof(languages, context), "لا تثبت البيانات عربية السجل"),
        Rule(test(normalize(title, UPLOAD), packs.UPLOAD["reject_title"]) | test(normalize(title, UPLOAD), packs.UPLOAD["contextual_reject_title"]), DIWAN_REASONS[3]),
        Rule(part_of_collection(normalize(title, UPLOAD)), DIWAN_REASONS[4]), Rule(evidence == "", DIWAN_REASONS[5]),
    ])


def diwan_score(evidence: Column, poet_name: Column, subject: Column, description: Column, languages: Column, faithful_v4: bool = False) -> Column:
    """Evidence 10, 8 or 6; poet 4; subject 2; description 1; language 1. v4 never gives the 8: it looks for a prefix that no evidence has."""
    second = F.lit(False) if faithful_v4 else evidence.startswith("البيانات الوصفية تثبت")
    base = F.when(evidence.startswith("العنوان"), 10).when(second, 8).otherwise(6)
    return base + score([Rule(poet_name != "", 4), Rule(F.length(subject) > 10, 2), Rule(F.length(description) > 30, 1), Rule(record_is_arabic(languages), 1)])


def merge_reason(title: Column, author: Column, signals: Column, pack=packs.MERGE) -> Column:
    """Why a source record does not enter the merged diwan catalog, or null."""
    cleaned, name = clean_catalog_title(title), squeeze(F.coalesce(author, F.lit("")))
    generic = test(normalize(name, UPLOAD), pack["generic_author"]) & ~test(cleaned, (r"(?:ديوان|قصائد|اشعار|أشعار)", ""))
    conditions = (~arabic_text(cleaned, 0.58, pack["foreign_script"]), test(F.concat_ws(" ", cleaned, name, squeeze(signals)), pack["foreign_language_signal"]), test(normalize(cleaned, UPLOAD), pack["non_diwan_title"]), generic)
    return first_match([Rule(c, r) for c, r in zip(conditions, MERGE_REASONS, strict=True)])


def confidence(title: Column, author: Column, evidence: Column, url: Column) -> Column:
    named = (squeeze(F.coalesce(author, F.lit(""))) != "") & ~test(author, (r"لم\s+يثبت", ""))
    return F.when(F.coalesce(evidence, F.lit("")).contains("العنوان يصرح"), 8).otherwise(5) + score([Rule(named, 3), Rule(F.length(title) > 8, 1), Rule(F.coalesce(url, F.lit("")) != "", 1)])


def refine_reason(cleaned: Column, pack=packs.REFINE) -> Column:
    key = normalize(cleaned, REFINE)
    noise = test(key, pack["obvious_download_noise"]) & ~test(key, (r"^ديوان\s+", ""))
    return first_match([Rule(cleaned == "", REFINE_REASONS[0]), Rule(test(key, pack["reject"]), REFINE_REASONS[1]), Rule(noise, REFINE_REASONS[2])])


def _signal(key: Column, words, patterns) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | key.contains(w)
    for p in patterns:
        out = out | test(key, (p, ""))
    return out


def thesis_signals(title: Column) -> tuple[Column, Column, Column]:
    """(score, tags, names) of a thesis title; excluded subjects score -10."""
    key = normalize(title, THESIS)
    found = [(name, tag, s, _signal(key, words, patterns)) for name, tag, s, words, patterns in packs.THESIS_SIGNALS]
    total = score([Rule(c, s) for _, _, s, c in found])
    strong = F.lit(False)
    for _, _, s, c in found:
        if s >= 6:
            strong = strong | c
    excluded = _signal(key, packs.THESIS_EXCLUSIONS, ())
    false = _signal(key, (), packs.THESIS_FALSE_TOPICS)
    return F.when(false | (excluded & ~strong), -10).otherwise(total), all_matches([Rule(c, tag) for _, tag, _, c in found]), all_matches([Rule(c, name) for name, _, _, c in found])


def thesis_level(text: Column) -> Column:
    key = normalize(text, THESIS)
    return F.when(key.contains(LEVELS[0]), LEVELS[0]).when(key.contains(LEVELS[1]), LEVELS[1]).otherwise(LEVELS[2])


def risk_flags(key: Column, rules=packs.RISK_RULES) -> Column:
    """All labels whose pattern a normalised title meets."""
    return all_matches([Rule(test(key, (p, "")), label) for label, p in rules])


def title_review(title: Column, rules=packs.LINGUISTICS_REVIEW) -> Column:
    """All labels of a review that a shown title meets; what is school-like is not pedagogic besides."""
    of = {label: test(title, (p, "i")) for label, p in rules}
    school = of.get("school-like", F.lit(False))
    return all_matches([Rule(c & ~school if label == "pedagogic" else c, label) for label, c in of.items()])


def review_counts(df: DataFrame, title: str, rules=packs.LINGUISTICS_REVIEW) -> DataFrame:
    """(label, n) of a review over accepted records, labels without rows included; one pass."""
    labels = title_review(F.col(title), rules)
    one = df.select(labels.alias("labels")).agg(*(F.count_if(F.array_contains("labels", label)).alias(label) for label, _ in rules))
    pairs = F.array(*(F.struct(F.lit(label).alias("label"), F.col(f"`{label}`").alias("n")) for label, _ in rules))
    return one.select(F.explode(pairs).alias("p")).select("p.label", "p.n")


def canonical_keys(titles: Sequence[str]) -> list[str]:
    """Canonical keys of listed titles, on the driver."""
    from ..functions.normalize import IMPORT, py_normalize

    return [py_normalize(t.replace("_", " "), IMPORT) for t in titles]


