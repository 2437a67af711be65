"""Superseded criteria, kept so that earlier catalogs can be built again: three classifications of diwans, an unweighted thesis selection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.normalize import DIWAN, LIGHT_BUILDER, THESIS, normalize
from ..functions.text import arabic_text, clean_person, clean_title, has_word, replace_all, squeeze, test, trim
from .filters import title_beside_diwan
from .rules import Rule, all_matches, first_match, score

# --- fixed values: patterns, steps and reasons of the superseded criteria ---
TITLE_1 = ((r"^book\s+", "i", ""), (r"^\d+\s+(?:كتاب|book)\s+", "i", ""), (r"\s*\[[^\]]+\]\s*(?:---|–|—)\s*.*", "", ""), (r"\s+(?:pdf|word|htm|html)$", "i", ""))
TITLE_2 = (
    (r"[‎‏‪-‮]", "", ""), (r"^[\s._\-—–·•ـ]+", "", ""), (r"^\d{3,7}[_\-\s]*", "", ""), (r"^book\s+", "i", ""), (r"^\d+\s+(?:كتاب|book)\s+", "i", ""),
    (r"\s*\[[^\]]{1,80}\]\s*(?:---|–|—)\s*.*", "", ""), (r"\s+(?:pdf|word|htm|html)$", "i", ""),
)
NOT_ALONE_1 = r"(دراسه|رساله|اطروحه|بحث|شرح|فهرس|معجم|نقد|تحليل|قراءه|موازنه|ببليوغرافيا|مختارات|مجموعه\s+(?:من\s+)?(?:ديوان|دواوين)|ديوانين|دواوين|في\s+ديوان)"
POETRY_1 = r"(شعر|قصائد|شاعر|ديوان)"
CONTAINER_1 = r"^(كتاب|مكتبه|مجموعه|سلسله|ملف)\s+"
POETRY_2 = r"(شعر|قصيد|قصائد|شاعر|شعرية|ديوان)"
NOT_DIWAN_2 = r"(?:دراسه|رساله|اطروحه|بحث|شرح|فهرس|معجم|نقد|تحليل|قراءه|موازنه|ببليوغرافيا|مكتبه|موسوعه|تاريخ|سجل|اداره|موظف|وظائف|ديوان\s+(?:المبتدا|المبتدأ|الخبر|العبر|الانشاء|الإنشاء|الرسائل|الخراج|المحاسبه|المحاسبة|المظالم|العدل|الخدمه|الخدمة|المال|الماليه|المالية|الشكاوي|الشكاوى|الوزاره|الوزارة|الدوله|الدولة|الوقف|الحساب|الاموال|الأموال|العقارات|الضرائب)|ديوان\s+الشعر\s+العربي|ديوان\s+اللصوص|ديوان\s+الفكاهه|ديوان\s+الفكاهة|ديوان\s+الادب|ديوان\s+الأدب)"
NOT_DIWAN_3 = r"(?:دراسه|رساله|اطروحه|بحث|شرح|فهرس|معجم|نقد|تحليل|قراءه|موازنه|ببليوغرافيا|مكتبه|موسوعه|تاريخ|سجل|اداره|ديوان\s+(?:المبتدا|المبتدأ|الخبر|العبر|الانشاء|الإنشاء|الرسائل|الخراج|المحاسبه|المحاسبة|المظالم|العدل|الخدمه|الخدمة|المال|الماليه|المالية|الشكاوي|الشكاوى|الوزاره|الوزارة|الدوله|الدولة|الوقف|الحساب|الاموال|الأموال|العقارات|الضرائب)|ديوان\s+(?:الشعر\s+العربي|الشعر\s+العربى|اللصوص|الفكاهه|الفكاهة|الادب|الأدب))"
PART_2 = r"(?:الجزء|جزء|المجلد|مجلد|ج\.?\s*\d+|الجزءان|الجزئين|القسم)\s*(?:الاول|الأول|الثاني|الثالث|الرابع|[0-9٠-٩]+)?(?:\s+من)?"
EDITION_2 = r"(?:\s|[-–—،:])(?:ت\.?|تحقيق|طبعه|طبعة|نشر|مراجعه|مراجعة|شرح|دراسه|دراسة|pdf|word|htm|html).*"
REASONS_1 = ("عنوان مفقود", "لا يثبت أي حقل وصفي أنه ديوان", "عنوان دراسة أو شرح أو فهرس أو مجموعة لا تمثل ديواناً مستقلاً", "عنوان حاوية أو ملف لا يمثل ديواناً مستقلاً", "لا يوجد سياق شعري كافٍ في البيانات الوصفية")
REASONS_2 = ("عنوان مفقود", "عنوان السجل ليس عربياً بما يكفي", "لا يثبت العنوان أو الوصف المقترن أن السجل هو الديوان نفسه", "لا يوجد سياق شعري في البيانات الوصفية", "العنوان يدل على دراسة أو سجل مؤسسي أو موضوع غير ديواني")
REASONS_3 = ("عنوان مفقود", "عنوان غير عربي", "البيانات لا تثبت أن السجل هو الديوان", "لا يوجد سياق شعري", "دراسة أو سجل غير ديواني")
LINGUISTIC = (
    ("اللغة العربية", r"اللغة\s+العربية|اللغ[ةوي]+\s+العربية"), ("علم اللغة", r"علم\s+اللغ[ةوي]+|اللسانيات|لساني"), ("نحو", r"\bالنحو\b|نحوي"), ("صرف", r"\bالصرف\b|صرفي"), ("بلاغة", r"\bالبلاغة\b|بلاغي"),
    ("معجم لغوي", r"\bالمعجم\b|معجمي"), ("الدلالة", r"\bالدلالة\b|دلالي"), ("الصوتيات", r"صوتي|الأصوات"), ("إملاء", r"إملاء|املاء"), ("الترجمة", r"ترجمة|ترجمي"), ("الخطاب", r"الخطاب|تداولي"), ("النص", r"نصي|النصوص"),
    ("الأسلوب", r"أسلوبي"), ("القراءة", r"القراءات|القراءة"), ("الكتابة", r"الكتابة|الخط العربي"), ("التعريب", r"التعريب|المعرّب|المعرب"), ("القواعد", r"قواعد\s+(?:اللغة|العربية|النحو|الإملاء|الاملاء)"),
)
LITERARY = (("شعر وأدب", r"\bالشعر\b|شعرية|قصيدة|القصائد|ديوان|الشاعر|أدب عربي|الأدب العربي|سردي|السرد|الرواية|روائي|مسرحية|مسرحيات|نقد أدبي"),)
NAMED_TAGS = ("نحو", "صرف", "بلاغة", "معجم لغوي")
OTHER_TAG = "دراسات لغوية"


def _reason(texts: tuple[str, ...], *conditions: Column) -> Column:
    return first_match([Rule(c, r) for c, r in zip(conditions, texts, strict=True)])


def reason_1(title: Column, subject: Column, description: Column) -> Column:
    """The first criteria: any field that says diwan, no word of studies, no container; null if eligible."""
    clean = clean_title(title, TITLE_1)
    key = lambda c: normalize(F.coalesce(c, F.lit("")), LIGHT_BUILDER)
    named = has_word(key(clean), "ديوان") | has_word(key(subject), "ديوان") | has_word(key(description), "ديوان")
    everything = key(F.concat_ws(" ", title, subject, description))
    return _reason(REASONS_1, clean == "", ~named, test(key(clean), (NOT_ALONE_1, "")), test(key(clean), (CONTAINER_1, "")), ~test(everything, (POETRY_1, "")))


def basis_1(title: Column, subject: Column, description: Column) -> Column:
    """Which field says diwan first; empty if none does."""
    says = lambda c: has_word(normalize(F.coalesce(c, F.lit("")), LIGHT_BUILDER), "ديوان")
    return first_match([Rule(says(clean_title(title, TITLE_1)), "العنوان"), Rule(says(subject), "الموضوع"), Rule(says(description), "الوصف")], "")


def reason_2(title: Column, subject: Column, description: Column) -> Column:
    """The second criteria: the title says diwan, or the metadata beside the title does."""
    clean = clean_title(title, TITLE_2)
    key, context = normalize(clean, DIWAN), F.concat_ws(" ", normalize(F.coalesce(subject, F.lit("")), DIWAN), normalize(F.coalesce(description, F.lit("")), DIWAN))
    named = has_word(key, "ديوان") | title_beside_diwan(key, context)
    return _reason(REASONS_2, clean == "", ~arabic_text(clean, foreign=None), ~named, ~test(context, (POETRY_2, "")), test(key, (NOT_DIWAN_2, "")))


def reason_3(title: Column, subject: Column, description: Column) -> Column:
    """The third criteria: the title says diwan, or a field has the word before the title."""
    clean = clean_title(title, TITLE_2)
    key, own, told = (normalize(F.coalesce(c, F.lit("")), DIWAN) for c in (clean, subject, description))
    before = F.concat(F.lit("ديوان "), key)
    named = has_word(key, "ديوان") | ((F.length(key) > 3) & (own.contains(before) | told.contains(before)))
    return _reason(REASONS_3, clean == "", ~arabic_text(clean, foreign=None), ~named, ~test(F.concat_ws(" ", own, told, key), (POETRY_2, "")), test(key, (NOT_DIWAN_3, "")))


def score_1(title: Column, subject: Column, description: Column, author: Column, language: Column) -> Column:
    says = lambda c: has_word(normalize(F.coalesce(c, F.lit("")), LIGHT_BUILDER), "ديوان")
    told = F.length(F.coalesce(description, F.lit("")))
    fields = [Rule(says(clean_title(title, TITLE_1)), 8), Rule(says(subject), 4), Rule(says(description), 3), Rule(clean_person(author) != "", 3)]
    return score([*fields, Rule(told > 40, 2), Rule(told.between(1, 40), 1), Rule(F.length(subject) > 10, 1), Rule(F.lower(language) == "ara", 1)])


def canonical_title_2(title: Column) -> Column:
    """The second canonical title: no part of a volume, and from the word diwan on if it has one."""
    key = trim(replace_all(normalize(clean_title(title, TITLE_2), DIWAN), ((r"^\d+\s*", "", ""),)))
    whole = squeeze(replace_all(key, ((PART_2, "", " "),)))
    ending = F.regexp_extract(whole, r"(?:^|\s)(ديوان\s+.+)\z", 1)
    return squeeze(replace_all(F.when(ending != "", ending).otherwise(whole), ((EDITION_2, "", ""),)))


def thesis_names_1(text: Column) -> tuple[Column, Column]:
    """(linguistic, literary) signals of a thesis, all of equal weight."""
    key = normalize(text, THESIS)
    return tuple(all_matches([Rule(test(key, (p, "")), name) for name, p in rules]) for rules in (LINGUISTIC, LITERARY))


def thesis_tags_1(text: Column) -> Column:
    """Tags of a thesis by those signals; null if it has none."""
    linguistic, literary = thesis_names_1(text)
    named = F.array_intersect(F.array(*map(F.lit, NAMED_TAGS)), linguistic)
    tags = F.when(F.size(named) > 0, named).otherwise(F.array(F.lit(OTHER_TAG)))
    return F.when(F.size(linguistic) > 0, tags).when(F.size(literary) > 0, F.array(F.lit(LITERARY[0][0])))
