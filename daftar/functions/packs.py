"""Rule packs: the patterns that decide topics, languages and rejections.

ECMAScript patterns with their flags; ``functions.regexjs.js`` makes them Java ones."""

from __future__ import annotations

# --- fixed values: patterns as the catalog's rules state them ---
TITLES = {
    "rhetoric": (r"بلاغ(?:ة|ي|يه)|بيان|بديع|معان[يى]|فصاح(?:ة|ه)|مجاز|تشبيه|استعار(?:ة|ه)|كناي(?:ة|ه)|إعجاز|إيجاز|ايجاز|إطناب|اطناب|أسلوب(?:ية|ي)?|اسلوب(?:ية|ي)?|نظم|حجاج", "i"),
    "grammar": (r"نحو|إعراب|اعراب|نحوي|النحو العربي|أقسام الكلام|الجمل(?:ة|)|جملة|العوامل|المعمولات|الحال|النعت|المفعول|العطف|اسم الفاعل|الحروف الناسخة|ظن وأخواتها|كاد وأخواتها|كان وأخواتها|التابع|المتبوع|حرف الوصل|التذكير والتأنيث|التعريف والتنكير|النداء|لو الامتناع|القياس الإعرابي|القياس الاعرابي|اللاحقة الإسنادية|اللاحقة الاسنادية|الماضي|الفعل الثلاثي|المشتقات|ضمائر", "i"),
    "morphology": (r"(?:ال)?صرف|صرف(?:ي|ية)?|تصريف|تصاريف|بنية الكلمة|اشتقاق|الإبدال|الابدال|الإعلال|الاعلال|الإدغام|الادغام|الإمالة|الامالة|التصغير|اسم الآلة|اسم الاله|فعيل|فعال|النسب|المشتقات", "i"),
    "dictionary": (r"(?:معجم|قاموس|معاجم|قواميس|الصحاح|المفردات|ترجمة المفردات|غريب السيرة|غريب|ألفاظ|الالفاظ|مفردات)", "i"),
    "linguistics": (r"لسان(?:ي|يات)|لغوي|لغة عربية|اللغة العربية|لغة العلم|لغة الحوار|لغة أجنبية|اللغة الأجنبية|إزدواجية اللغة|ازدواجية اللغة|أقدم اللغات|التنبيه في اللغة|دلالة|دلالي|صوت(?:ي|يات|يّة)|مخارج الأصوات|مخارج الاصوات|لهج(?:ة|ات)|عامية|فصحى|إملاء|املاء|رسم|الخط العربي|الخطوط|خطوط|تعريب|مصطلح|مصطلحات|التشامي في اللغة|التصحيح|تصويب قول العامة|التصحيف|التقاء الساكنين|الياء|كسر ياء|أبجدية عربية|ابجدية عربيه|القرائية|القرائيه|مقارنة لغوية|مقارنه لغويه|التطور الدلالي|التوزيع|التوزبع|التداولية|التداوليه|النصي|النصيّة", "i"),
    "literature": (r"شعر|أشعار|اشعار|شاعر|شعراء|أدب|ادب|قصيدة|قصيده|ديوان|دواوين|نقد أدبي|النقد الأدبي|النقد الادبي|رواية|روايه|قصة|قصه|مقامة|مقامات|التناص|الانزياح|المنامات|مدحة|مدحه|غزلية|غزليه|الحماسة|الحماسه|حازم القرطاجني|الجاحظ|ابن الرومي|المتنبي|المعري|امرئ القيس|امرؤ القيس|أمرؤ القيس|ابو نواس|أبو نواس|شكري فيصل|ابن زيدون|الناشئ|الشعر الجاهلي|شعر الجاهلي|شعراء عباسيون|المقدمة الغزلية|المقدمه الغزليه", "i"),
    "education_language": (r"تعليم العربية|التدريس بالعربية|التدريس بالعربيه|معالجة الضعف الكتابي|المهارات القرائية|المهارات القرائيه|العملية التعليمية|العمليه التعليميه|تدريس علم الأصوات|تدريس علم الاصوات", "i"),
    "explicit_exclusion": (r"^(?:أحاديث|أخبار مجمعية|استدراك|استشارة واستناره|إضافة الجهات الأربع|الأجرام السماوية|الاندلس في المغرب|الاوقاف الاسلامية بجوار المسجد الاقصى|البطريرك بعقوب الثالث.*|التأثير الإسلامي في كوميديا دانتي.*|التأويل الإرشادي عند الصوفية.*|التأويل الإشاري عند الصوفية.*|الفتح والأرض في الأندلس|القمر وأسماؤه في أطواره وأحواله|المرجئة بخراسان.*|المستعمرات الألمانية في فلسطين|المؤتمرات والندوات والمحاضرات|بناء الأسطول الأموي.*|تساؤلات|تعليقان|تعليقات ومناقشات|تعليق على تعليقات على كتاب المقنع في الفلاحة|تقريظ للمفتي ابن عمار.*|حول المقربصات.*|حول كتاب حساب التفاصل والتكامل|حول كتاب حساب التفاضل والتكامل|دراسات في النظم والعقائد الاباضية|رأي$|رسالة رئيس مجلس الأعيان|رسائل أبي الحسن العامري.*|سلوة الحزين في موت البنين|شفيق جبري في ذمه الله|عقيدة الخيام|فلا وربك لا يؤمنون$|في أيام غسان.*|قراءة في سورة القمر|قصة حي بن يقظان في تراثنا القديم.*|كتب الانساب وتاريخ الجزيزة|كشف الخفار في البيعه لعلي الرضا|كلمة مندوب جلالة الملك.*|مع الصحف|مخطوطة كتاب المثالب.*|نهايه الثغور الشامية|يوم الأرض|إدارة التغيير التنظيمي|كوميديا دانتي.*|السرد والتكنولوجيا.*|طبائع النساء وما جاء فيها.*|مجتمعات التعلم المهنية.*|زيارة وفد جزائري.*|رد على استيضاح الاخ.*|تأهيل اعضاء هيأه التدريس.*)$", "i"),
    "vague_title": (r"^(?:تساؤلات|استدراك|استشارة واستناره|تعليقات ومناقشات|تعليقان|رأي|ذيول وملاحظات|مع الصحف|تيسير على قاعدة|بل الواجب أن تكون بالعربية|وقفة مع اللغة|رأى في تحديد عصر الراغب الاصفهاني|كتاب نهاية السؤل والأمنية|الوقف|النسب|الرسائل والأطاريح الجامعية|المصطلح العلمي|المعجم الحديث|القيمة الموسيقية للتكرار في شعر الصاحب بن عباد)$", "i"),
    "non_language_context": (r"إدارة التغيير|حساب التفاضل|حساب التفاصل|الأجرام السماوية|الأسطول|الأوقاف|المستعمرات|حصار غزة|يوم الأرض|العقائد|البيعة|الأنساب|السياسية|الجغرافية|الفلاحة|الكهربا|التصوف|الحديث(?:ة)?$|سورة|الرسول صلي الله عليه وسلم لأهل المدينة|الملك المعظم|مكتبة.*الفرج بعد الشدة", "i"),
}
LITERATURE = {
    "rhetoric": (r"بلاغ(?:ة|ي|يه)|بيان|بديع|معان[يى]|فصاح(?:ة|ه)|مجاز|تشبيه|استعار(?:ة|ه)|كناي(?:ة|ه)|إعجاز|ايجاز|إطناب|اطناب|اسلوب(?:ية|ي)?|خطاب|تلخيص المفتاح|مختصر السعد|المطول|ايضاح|إيضاح|أسرار البلاغة|دلائل الإعجاز|جواهر البلاغة|البلاغة الواضحة|عروس الأفراح|عقود الجمان|مفتاح العلوم|المثل السائر|الطراز", "i"),
    "grammar": (r"نحو|إعراب|اعراب|نحوي|النحو العربي", "i"),
    "morphology": (r"(?:ال)?صرف|صرف(?:ي|ية)?|تصريف|تصاريف|بنية الكلمة|اشتقاق", "i"),
    "dictionary_cue": (r"(?:معجم|قاموس|معاجم|قواميس|مصطلحات)", "i"),
    "lexical_dictionary_context": (r"لغة|لغوي|العربية|عربي|ألفاظ|الالفاظ|كلمات|مفردات|معاني|دلالة|جذور|تراكيب|تعبيرات|أمثال|امثال|أضداد|اضداد|مترادفات|لهجات|عامية|فصحى|غريب|نحو|صرف|تصريف|بلاغة|عروض|قافية|شعر|أدب|ادب|نقد|لسانيات|أصوات|اصوات|صوتيات|أوزان|اوزان|استشهادات|مسائل", "i"),
    "lexical_dictionary": (r"(?:لسان العرب|تاج العروس|القاموس المحيط|الصحاح|العين|مقاييس اللغة|أساس البلاغة|تهذيب اللغة|جمهرة اللغة|المحكم والمحيط الأعظم|المعجم الوسيط|المعجم الوجيز|المعجم الكبير|المعجم العربي الأساسي)", "i"),
    "non_language_dictionary": (r"(?:معجم|قاموس)\s+(?:شيوخ|رجال|الصحابة|الرواة|البلدان|الأنساب|القبائل|الفتاوى|الفقه|الفقهاء|القراءات|المؤلفين|المخطوطات|الطرق الصوفية|تراجم|أعلام|اعلام|مدن|قرى|جغرافية|مترولوجيا|مصطلحات تاريخية|سياسية|قانونية|طبية|طب|هندسة|اقتصاد)", "i"),
    "literary_biography": (r"(?:شعراء|أدباء|ادباء|شعر|أدب|ادب|نقد|ديوان|قصائد|قافية|عروض)", "i"),
    "non_core_reference": (r"(?:المترولوجيا|معالم جغرافية|المعالم الجغرافية|مصطلحات تاريخية|التعريفات الفقهية|لغة الفقهاء|تاريخ مصر الحديث)", "i"),
    "linguistics": (r"لسان(?:ي|يات)|لغوي|لغة عربية|اللغة العربية|دلالة|صوتيات|أصوات|صوتي|تداولي|نص(?:ي|ية)|لسانيات", "i"),
    "literature": (r"أدب|ادب|شعر|عروض|قافية|نقد أدبي|النقد الأدبي|ديوان|رواية|قصة|مسرح|مسرحية|مقامة|مقامات|سيرة|ترجمة أدبية|تاريخ الأدب|مختارات", "i"),
    "thesis": (r"رسالة (?:ماجستير|دكتوراه)|أطروحة|اطروحة|دراسة ماجستير|دراسة دكتوراه|master thesis|doctoral dissertation", "i"),
    "excluded_topic": (r"طب|هندسة|اقتصاد|محاسبة|إدارة أعمال|قانون|سياسة|كيمياء|فيزياء|رياضيات|تمريض|زراعة|جغرافيا", "i"),
    "non_arabic_subject": (r"اللغة (?:الفارسية|الإنجليزية|الانجليزية|الفرنسية|التركية|الأردية|الاردية)|(?:الفارسية|الإنجليزية|الانجليزية|الفرنسية|التركية|الأردية|الاردية)\s+(?:للمبتدئين|لغير الناطقين|قواعد|نحو|صرف)", "i"),
    "non_prosody_arood": (r"(?:العروض|عروض)\s+(?:المسرح(?:ية)?|التجاري(?:ة)?|الضوئي(?:ة)?|السينمائي(?:ة)?|الفني(?:ة)?|الموسيقي(?:ة)?|العسكري(?:ة)?|الطبي(?:ة)?|السعري(?:ة)?|على\s+الأرض|على\s+خشبات|في\s+المسرح)|عروض\s+مسرح|زكاة\s+العروض|المضاربة\s+على\s+العروض|عروض\s+التجارة", "i"),
    "educational_worksheet": (r"مراجعة(?:\s+نهائية)?|اختبار(?:ات)?|امتحان(?:ات)?|(?:إ|ا)جاب(?:ة|ات)(?:ها)?(?:\s+(?:نموذجية|الامتحان|الاسترشادية))?|الأسئلة\s+المتكررة|تصحيح\s+موضوع|شهادة\s+التعليم|الثانوية\s+العامة|الصف\s+(?:الأول|الاول|أول|اول|الثاني|الثانى|ثاني|ثانى|الثالث|ثالث|الرابع|رابع|الخامس|خامس|السادس|سادس|السابع|الثامن|التاسع|العاشر|الحادي|الحادى|\d+)|\bصف\s+(?:الأول|الاول|أول|اول|الثاني|الثانى|ثاني|ثانى|الثالث|ثالث|الرابع|رابع|الخامس|خامس|السادس|سادس|\d+)|بكالوريا|(?:^|\s)(?:مذكرة|ال?ملزمة|تحضير|تدريبات|تمارين|نشاط|أنشطة|واجبات)(?:\s|$)|أوراق?\s*عمل|كتاب\s*(?:الطالب|التلميذ)|دليل\s*(?:المعلم|الطالب)|الفصل\s+الدراسي|الترم|وزارة\s+التربية|التقويم\s+التشخيصي|المنهج\s+الجديد|(?:^|\s)(?:السنة\s+)?(?:الأولى|الاولى|الأول|الاول|أول|اول|الثانية|الثاني|الثانى|ثاني|ثانى|الثالثة|الثالث|ثالث|الرابعة|الرابع|رابع|الخامسة|الخامس|خامس|السادسة|السادس|سادس|اولى|ثانية|ثانى|ثالثة|ثالث|رابعة|رابع|خامسة|خامس|سادسة|سادس|\d+)\s+(?:ابتدائي(?:ة)?|إعدادي(?:ة)?|اعدادي(?:ة)?|ثانوي(?:ة)?)|تلاميذ|توزيع\s+مناهج|ملخص\s+رسالة|النموذج\s+(?:الأول|الاول|الثاني|الثانى|الثالث|الرابع|الخامس|السادس)\s+(?:بالإجابات|بالاجابات|الاسترشادي|الرسمي)", "i"),
    "arabic_language": (r"^(?:ar|ara|arabic|arab|العربية|اللغة العربية)$", "i"),
    "arabic_language_text": (r"اللغة العربية|لغة عربية|نص عربي|arabic language|in arabic|arabic text", "i"),
    "non_arabic_language": (r"^(?:en|eng|english|fr|fra|fre|french|de|ger|german|tr|tur|turkish|fa|fas|per|persian|ur|urd|urdu|es|spa|spanish|it|ita|italian|ru|rus|russian)$", "i"),
}
GRAMMAR = {
    "rhetoric": (r"بلاغ(?:ة|ي|يه)|بيان|بديع|معان[يى]|فصاح(?:ة|ه)|مجاز|تشبيه|استعار(?:ة|ه)|كناي(?:ة|ه)|إعجاز|ايجاز|إطناب|اطناب|اسلوب(?:ية|ي)?|خطاب|نظم|تلخيص المفتاح|مختصر السعد|المطول|ايضاح|إيضاح|أسرار البلاغة|دلائل الإعجاز|جواهر البلاغة|البلاغة الواضحة|عروس الأفراح|عقود الجمان|مفتاح العلوم|المثل السائر|الطراز", "i"),
    "grammar": (r"نحو|إعراب|اعراب|نحوي|النحو العربي", "i"),
    "nahw_irab": (r"نحو|إعراب|اعراب|نحوي|النحو العربي|الآجرومية|الاجرومية|ألفية ابن مالك|الألفية|ابن هشام|المفصل|الجمل في النحو|الكافية في النحو|عوامل النحو|قواعد النحو|منصوبات|مرفوعات|مجرورات|تيسير النحو|النحو التطبيقي|معاني النحو|شرح قطر الندى|شذور الذهب", "i"),
    "morphology": (r"صرف|صر(?:في|فية)|بنية الكلمة|اشتقاق", "i"),
    "dictionary": (r"معجم|قاموس|مصطلحات", "i"),
    "linguistics": (r"لسان(?:ي|يات)|لغوي|لغة عربية|اللغة العربية|دلالة|صوتيات|أصوات|صوتي|تداولي|نص(?:ي|ية)|لسانيات", "i"),
    "literature": (r"أدب|ادب|شعر|عروض|قافية|نقد أدبي|النقد الأدبي|ديوان", "i"),
    "excluded_topic": (r"طب|هندسة|اقتصاد|محاسبة|إدارة أعمال|قانون|سياسة|كيمياء|فيزياء|رياضيات|تمريض|زراعة|جغرافيا", "i"),
    "non_arabic_subject": (r"اللغة (?:الفارسية|الإنجليزية|الانجليزية|الفرنسية|التركية|الأردية|الاردية)|(?:الفارسية|الإنجليزية|الانجليزية|الفرنسية|التركية|الأردية|الاردية)\s+(?:للمبتدئين|لغير الناطقين|قواعد|نحو|صرف)", "i"),
    "educational_worksheet": (r"مراجعة نهائية|المراجعة النهائية|اختبار(?:ات)?|امتحان(?:ات)?|إجابة (?:نموذجية|الامتحان)|الثانوية العامة|الصف\b|بكالوريا|(?:لتلاميذ|تلاميذ|المدارس|المرحلة|الإعدادية|الابتدائية|الاعدادية|الابتدائية)|ملخص رسالة|تدريبات (?:محلولة|على)", "i"),
    "arabic_language": (r"^(?:ar|ara|arabic|arab|العربية|اللغة العربية)$", "i"),
    "arabic_language_text": (r"اللغة العربية|لغة عربية|نص عربي|arabic language|in arabic|arabic text", "i"),
    "non_arabic_language": (r"^(?:en|eng|english|fr|fra|fre|french|de|ger|german|tr|tur|turkish|fa|fas|per|persian|ur|urd|urdu|es|spa|spanish|it|ita|italian|ru|rus|russian)$", "i"),
}
RHETORIC = {
    "rhetoric": (r"بلاغ(?:ة|ي|يه)|بيان|بديع|معان[يى]|فصاح(?:ة|ه)|مجاز|تشبيه|استعار(?:ة|ه)|كناي(?:ة|ه)|إعجاز|ايجاز|إطناب|اطناب|اسلوب(?:ية|ي)?|خطاب|نظم|تلخيص المفتاح|مختصر السعد|المطول|ايضاح|إيضاح|أسرار البلاغة|دلائل الإعجاز|جواهر البلاغة|البلاغة الواضحة|عروس الأفراح|عقود الجمان|مفتاح العلوم|المثل السائر|الطراز", "i"),
    "grammar": (r"نحو|إعراب|اعراب|نحوي|النحو العربي", "i"),
    "morphology": (r"صرف|صر(?:في|فية)|بنية الكلمة|اشتقاق", "i"),
    "dictionary": (r"معجم|قاموس|مصطلحات", "i"),
    "linguistics": (r"لسان(?:ي|يات)|لغوي|لغة عربية|اللغة العربية|دلالة|صوتيات|أصوات|صوتي|تداولي|نص(?:ي|ية)|لسانيات", "i"),
    "literature": (r"أدب|ادب|شعر|عروض|قافية|نقد أدبي|النقد الأدبي|ديوان", "i"),
    "excluded_topic": (r"طب|هندسة|اقتصاد|محاسبة|إدارة أعمال|قانون|سياسة|كيمياء|فيزياء|رياضيات|تمريض|زراعة|جغرافيا", "i"),
    "educational_worksheet": (r"مراجعة نهائية|المراجعة النهائية|اختبار(?:ات)?|امتحان(?:ات)?|إجابة (?:نموذجية|الامتحان)|الثانوية العامة|الصف (?:الأول|الثاني|الثالث)|بكالوريا|تدريبات (?:محلولة|على)", "i"),
    "arabic_language": (r"^(?:ar|ara|arabic|arab|العربية|اللغة العربية)$", "i"),
    "arabic_language_text": (r"اللغة العربية|لغة عربية|نص عربي|arabic language|in arabic|arabic text", "i"),
    "non_arabic_language": (r"^(?:en|eng|english|fr|fra|fre|french|de|ger|german|tr|tur|turkish|fa|fas|per|persian|ur|urd|urdu|es|spa|spanish|it|ita|italian|ru|rus|russian)$", "i"),
}
DIWAN = {
    "reject_title": (r"(?:دراسه|رساله|اطروحه|بحث|شرح|فهرس|معجم|نقد|تحليل|قراءه|موازنه|اتجاهات|ببليوغرافيا|مكتبه|موسوعه|تاريخ|سجل|اداره|مجله|صحيفه|جريده|مقال|مقدمه|بحوث|ملحوظات|(?:ذيل|تكمله|تكملة|مستدرك|استدراك)\s+(?:على\s+)?ديوان|ديوان\s+(?:السنه|السنة|السنن|الحديث|الاحاديث|الأحاديث|الاثار|الآثار|الضعفاء|المتروكين|الزكاه|الزكاة|العرب)(?:\s|$)|و(?:ما\s+وصل\s+الينا\s+من\s+)?نثره|ورسائله|واخباره|ديوان\s+(?:المبتدا|المبتدأ|الخبر|العبر|الانشاء|الإنشاء|الرسائل|الخراج|المحاسبه|المحاسبة|المظالم|العدل|الخدمه|الخدمة|المال|الماليه|المالية|الشكاوي|الشكاوى|الوزاره|الوزارة|الدوله|الدولة|الوقف|الحساب|الاموال|الأموال|العقارات|الضرائب)|ديوان\s+(?:الشعر\s+العربي|الشعر\s+العربى|اللصوص|الفكاهه|الفكاهة|الادب|الأدب|النثر\s+العربي|المعاني))", "u"),
    "contextual_reject_title": (r"(?:^|\s)(?:دراسات|التكوينات|توظيف|الفائزون|جائزه)(?:\s|$).*?(?:^|\s)ديوان(?:\s|$)|(?:^|\s)(?:مع\s+)?تحقيق\s+ديوان(?:\s|$)|ديوان\s+(?:الاساطير|الاحكام|اسماء\s+(?:الضعفاء|المتروكين))(?:\s|$)|ديوان(?:\s|$).*?(?:رواياتي|روايات)(?:\s|$)", "u"),
    "generic_poet": (r"^(?:الشعر\s+العربي|الشعر\s+العربى|الادب|الأدب|الحماسه|الحماسة|القصائد|المختارات|الاشعار|الأشعار)$", "u"),
    "foreign_script": (r"[پچژگکۍێی]", "u"),
    "foreign_language_signal": (r"(?:فارسي|فارسية|الأدب\s+الفارسي|شعر\s+فارسي|تركي|تركية|اردو|إنجليزي|انجليزي|فرنسي|كردي)", "u"),
}
UPLOAD = {
    "foreign_script": (r"[پچژگکۍێی\u0700-\u074f]", "u"),
    "foreign_language_signal": (r"(?:فارسي|فارسية|الأدب\s+الفارسي|شعر\s+فارسي|تركي|تركية|اردو|إنجليزي|انجليزي|فرنسي|كردي|سرياني|السرياني|محمد\s+اقبال|عرفي)", "u"),
    "reject_title": (r"(?:دراسه|رساله|اطروحه|بحث|شرح|فهرس|معجم|نقد|تحليل|قراءه|موازنه|اتجاهات|ببليوغرافيا|مكتبه|موسوعه|تاريخ|سجل|اداره|مجله|صحيفه|جريده|مقال|مقدمه|بحوث|ملحوظات|جماليه|اسلوبيه|(?:ذيل|تكمله|تكملة|مستدرك|استدراك)\s+(?:على\s+)?ديوان|ديوان\s+(?:السنه|السنة|السنن|الحديث|الاحاديث|الأحاديث|الاثار|الآثار|الضعفاء|المتروكين|الزكاه|الزكاة|العرب)(?:\s|$)|و(?:ما\s+وصل\s+الينا\s+من\s+)?نثره|ورسائله|واخباره|ديوان\s+(?:المبتدا|المبتدأ|الخبر|العبر|الانشاء|الإنشاء|الرسائل|الخراج|المحاسبه|المحاسبة|المظالم|العدل|الخدمه|الخدمة|المال|الماليه|المالية|الشكاوي|الشكاوى|الوزاره|الوزارة|الدوله|الدولة|الوقف|الحساب|الاموال|الأموال|العقارات|الضرائب)|ديوان\s+(?:الشعر\s+العربي|الشعر\s+العربى|اللصوص|الفكاهه|الفكاهة|الادب|الأدب|النثر\s+العربي|المعاني))", "u"),
    "contextual_reject_title": (r"(?:^|\s)(?:دراسات|التكوينات|توظيف|الفائزون|جائزه)(?:\s|$).*?(?:^|\s)ديوان(?:\s|$)|(?:^|\s)(?:مع\s+)?تحقيق\s+ديوان(?:\s|$)|(?:^|\s)جزء\s+من\s+ديوان(?:\s|$)|ديوان\s+(?:الاساطير|الاحكام|اسماء\s+(?:الضعفاء|المتروكين)|اهل\s+البيت|الائمه|الأئمة)(?:\s|$)|ديوان(?:\s|$).*?(?:رواياتي|روايات)(?:\s|$)|^ديوان\s+علي$", "u"),
    "generic_person": (r"^(?:الشعر\s+العربي|الشعر\s+العربى|الادب|الأدب|الحماسه|الحماسة|القصائد|المختارات|الاشعار|الأشعار|مجموعه\s+من|عدة\s+مؤلفين|مجهول|غير\s+معروف|لم\s+يثبت)", "u"),
}
MERGE = {
    "foreign_script": (r"[پچژگکۍێی]", "u"),
    "foreign_language_signal": (r"(?:فارسي|فارسية|الأدب\s+الفارسي|شعر\s+فارسي|تركي|تركية|اردو|إنجليزي|انجليزي|فرنسي|كردي)", "u"),
    "non_diwan_title": (r"(?:^|\s)(?:أناشيد|اناشيد|نشيد|المستدرك|فهرس|دليل|دراسة|دراسه|رسالة|رساله|أطروحة|اطروحة|شرح|شروح|معلقات|المعلقات|مختارات|اختيارات|موسوعة|موسوعه|روائع|نزهة|نزهه|مجموع\s+اشعار|اشعار\s+النساء|حدوتة\s+كتاب|حدوته\s+كتاب|الشعرية|شعريه|نقد|قراءة|قراءه|تحليل|ديوان\s+(?:المعاني|النثر\s+العربي|الشعر\s+العربي|الشعراء)|شعراء\s+العرب)(?:\s|$)|(?:\s|^)(?:ورسائله|ورسائله|ونثره|نثره|وأخباره|واخباره)(?:\s|$)|(?:^|\s)(?:في|عن)\s+ديوان\s+", "u"),
    "generic_author": (r"^(?:مجموعة\s+من|عدة\s+مؤلفين|مجهول|غير\s+معروف|لم\s+يثبت)", "u"),
}
REFINE = {
    "reject": (r"(?:^|\s)(?:دراسات|التكوينات|توظيف|الفائزون|جائزه|جائزة)(?:\s|$).*?\bديوان\b|(?:^|\s)(?:مع\s+)?تحقيق\s+ديوان(?:\s|$)|ديوان\s+(?:الاساطير|الأَساطير|الاحكام|الأحكام|اسماء\s+(?:الضعفاء|المتروكين))(?:\s|$)|ديوان(?:\s|$).*?رواياتي(?:\s|$)|(?:^|\s)(?:كتاب\s+)?(?:صيغه|صيغة)\s+(?:وورد|word)(?:\s|$)", "u"),
    "obvious_download_noise": (r"(?:^|\s)(?:pdf|epub|online|اونلاين)(?:\s|$)", "iu"),
}
CATEGORY_TAG = {
    "الإملاء والرسم والخط": "دراسات لغوية",
    "البلاغة والأسلوبية": "بلاغة",
    "التعريب والمصطلح": "دراسات لغوية",
    "الصرف والاشتقاق": "صرف",
    "اللهجات واللغة الاجتماعية": "دراسات لغوية",
    "المعاجم والقواميس": "معجم لغوي",
    "النحو والإعراب": "نحو",
    "تاريخ اللغة والمقارنة": "دراسات لغوية",
    "تعليم العربية واللسانيات التطبيقية": "دراسات لغوية",
    "علم الأصوات": "دراسات لغوية",
    "علم الدلالة": "دراسات لغوية",
    "فقه اللغة واللسانيات": "دراسات لغوية",
}
RELEVANT_TITLES = (
    "بين الكوفيين والبصريين",
    "تأملات في كتاب الخاطريات لابن جني",
    "التبيين في فوائد القدماء والعصريين",
    "تذكرة النحاة لأبي حيان بن يوسف الغرناطي الأندلسي ت 745ه نقد واستدراك",
    "مراجعة البحث الموسوم ب تذكرة النحاة لأبي حيان محمد بن يوسف الغرناطي الأندلسي ت 745ه نقد واستدراك",
    "فيعل ام فعيل",
    "مع مؤيدي المجاز ومنكريه",
    "مقابسة في جملة الصلة هل تقع شرطا",
    "مناقشة رأي في علامة التأنيث",
    "موقف من يونس بن حبيب",
    "قراءة في كتاب التبيين عن مذاهب النحويين البصريين والكوفيين",
    "تقعيد قاعدة نحوية إضافة الجهات الأربع",
    "تقعيد قاعدة نحوية تعليق على تعليق",
    "ملاحظات حول عديد بمعنى معدود",
    "ما جاء على فعال من اسم الآلة",
    "مع الياء من اسم العلم العاصي",
    "تحرير اسم الفاعل من مزاعم المجاراه",
    "حتي العاطفة علي غير مذكور",
    "كلمات في الصحاح",
    "من الاحتباك إلى الاعتداد بالمبني العدمي",
    "اللغة الشاعرة",
    "التشامي في اللغة",
)
MANUAL_TITLE_TAGS = {
    "استدراك وتعليق على كتاب حروف الممدود والمقصود لابن السكيت المتوفى 244ه": "صرف",
    "استدراك وتعليق على كتاب حروف الممدود والمقصور لابن السكيت المتوفي 244 هحريا": "صرف",
    "إصلاح كتاب الحيوان": "شعر وأدب",
    "إصلاح أمالي القالي وما ألحق به": "شعر وأدب",
    "كتاب الآمل والمأمول المنسوب للجاحظ": "شعر وأدب",
    "بين الكوفيين والبصريين": "نحو",
    "تأملات في كتاب الخاطريات لابن جني": "دراسات لغوية",
    "تأملات في كتاب الخاطريات لابن جني القسم الأول": "دراسات لغوية",
    "حتي العاطفة علي غير مذكور": "نحو",
    "حول كتاب سيبويه": "نحو",
    "شرح جمل الزجاجي لأبي الحسن علي بن محمد بن علي بن خروف الإشبيلي ت609 تحقيق ودراسة القسم الأول": "نحو",
    "شرح جمل الزجاجي لأبي السحن علي بن محمد بن علي بن خروف الاشبيلي تحقيق ودراسة القسم الثاني": "نحو",
    "ضبط أوزان منظومات وأشعار في كتاب الروض المغطار في خبر الأقطار": "شعر وأدب",
    "تنبيهات علي كتاب مثلثات قطرب المطبوع بتحقيق الدكتور رضا السويسي / عبد الله بن عمر الحاجة إبراهيم": "معجم لغوي",
}
# signal name, tag, score, any of these substrings, any of these patterns
THESIS_SIGNALS = (
    ("اللغة العربية", "دراسات لغوية", 6, ("اللغة العربية", "اللغوية العربية",), ()),
    ("علم اللغة", "دراسات لغوية", 6, ("علم اللغة",), (r"(^| )اللساني(?:ة|ات|ين)?(?: |$)",)),
    ("نحو", "نحو", 6, (), (r"(^| )النحو(?: |$)", r"(^| )النحوي(?:ة|ين|ات)?(?: |$)", r"(^| )نحوي(?:ة|ين|ات)?(?: |$)",)),
    ("صرف", "صرف", 6, (), (r"(^| )الصرف(?: |$)", r"(^| )الصرفي(?:ة|ين|ات)?(?: |$)", r"(^| )صرفي(?:ة|ين|ات)?(?: |$)",)),
    ("بلاغة", "بلاغة", 6, (), (r"(^| )البلاغ(?:ة|ي(?:ة|ين|ات)?)(?: |$)",)),
    ("معجم لغوي", "معجم لغوي", 6, (), (r"(^| )(المعجم|المعاجم|معجمي(?:ة|ين|ات)?)(?: |$)",)),
    ("الدلالة", "دراسات لغوية", 6, (), (r"(^| )الدلال(?:ة|ي(?:ة|ين|ات)?)(?: |$)",)),
    ("الصوتيات", "دراسات لغوية", 5, (), (r"(^| )(الصوت(?:ي(?:ة|ين|ات)?)?|الاصوات)(?: |$)",)),
    ("الإملاء", "دراسات لغوية", 5, (), (r"(^| )(الاملاء|الاملائي(?:ة|ين|ات)?)(?: |$)",)),
    ("اللهجات", "دراسات لغوية", 5, (), (r"(^| )(اللهج(?:ة|ات)|اللهجي(?:ة|ين|ات)?)(?: |$)",)),
    ("القراءات", "دراسات لغوية", 4, (), (r"(^| )القراءات(?: |$)",)),
    ("الترجمة", "دراسات لغوية", 4, (), (r"(^| )(الترجم(?:ة|ات|ي(?:ة|ين|ات)?))(?: |$)",)),
    ("الأسلوبية", "دراسات لغوية", 4, (), (r"(^| )(الاسلوبي(?:ة|ين|ات)?)(?: |$)",)),
    ("الخطاب", "دراسات لغوية", 4, ("تحليل الخطاب", "الخطاب اللغوي", "الخطاب الادبي", "الخطاب الشعري",), ()),
    ("النص", "دراسات لغوية", 4, ("النصية", "تحليل النص", "النص الادبي", "النصوص الادبية",), ()),
    ("التعريب", "دراسات لغوية", 4, (), (r"(^| )التعريب(?: |$)",)),
    ("العروض", "شعر وأدب", 5, (), (r"(^| )(العروض|العروضي(?:ة|ين|ات)?)(?: |$)",)),
    ("ديوان", "شعر وأدب", 5, (), (r"(^| )ديوان(?: |$)",)),
    ("الشعر", "شعر وأدب", 5, (), (r"(^| )(الشعر|الشعرية|القصيدة|القصائد|الشاعر)(?: |$)",)),
    ("الأدب", "شعر وأدب", 5, (), (r"(^| )(الادب|الادبية|النقد الادبي)(?: |$)",)),
    ("الرواية", "شعر وأدب", 5, (), (r"(^| )(الرواية|الروايات|الروائي(?:ة|ين|ات)?)(?: |$)",)),
    ("السرد", "شعر وأدب", 4, ("البناء السردي", "الخطاب السردي", "النقد السردي", "التحليل السردي", "السرد في",), ()),
)
THESIS_EXCLUSIONS = (
    "الهندسة",
    "الطب",
    "التمريض",
    "الصيدلة",
    "الكيمياء",
    "الفيزياء",
    "الزراعة",
    "المحاسبة",
    "الادارة",
    "القانون",
    "الاقتصاد",
    "الرياضيات",
    "الحاسوب",
    "التصميم الداخلي",
    "العمارة",
    "التمويل",
    "المصارف",
    "المعاملات",
    "العقيدة",
    "الفقه",
    "الاحكام",
    "البيئة",
    "الطاقة",
    "الطب الشرعي",
)
THESIS_FALSE_TOPICS = (
    "ازالة الشعر",
    "زراعة الشعر",
    "تساقط الشعر",
    "الشعر بالليزر",
    "الشعر الجلدي",
    "القراءة الصولفائية",
)
RISK_RULES = (
    ("بحث أو دراسة ظاهرة", r"(?:دراسه|رساله|اطروحه|بحث|شرح|نقد|تحليل|منهج|اتجاهات|قراءه|مقاربه|موازنه)"),
    ("سجل أو مؤسسة إدارية", r"(?:سجل|ديوان\s+(?:الوزاره|الوزارة|الدوله|الدولة|المال|المالية|الخراج|الوقف|الحساب|الرسائل|الانشاء|الإنشاء|المظالم|العدل))"),
    ("مجموعة أو جزء غير مستقل", r"(?:الجزء|المجلد|مجموعه|مختارات|منتخبات|الاعمال\s+الشعريه\s+الكامله)"),
    ("مجال ديني أو تاريخي غير شعري", r"(?:ديوان\s+(?:السنه|السنة|السنن|الحديث|الاحاديث|الآثار|الاثار|العرب|الخبر|العبر))"),
    ("تلوث عنوان تحميل", r"(?:كتاب\s+اقرا|اونلاين|online|pdf|epub)"),
)
SUSPICIOUS_RULES = (
    ("دراسة أو بحث ظاهر", r"(?:دراسه|رساله|اطروحه|بحث|شرح|نقد|تحليل|منهج|حياته)"),
    ("فهرس أو معجم أو سجل ظاهر", r"(?:فهرس|معجم|سجل|موسوعه|مجله|صحيفه|جريده)"),
    ("مجموع أو جزء ظاهر", r"(?:الجزء|مجلد|مجموعه|مختارات|منتخبات|الاعمال الشعريه الكامله)"),
    ("تلوث بعنوان التحميل أو القراءة", r"(?:كتاب اقرا|اونلاين|online|pdf)"),
)
#: Reviews of accepted titles, by the batch that they are made for: label and pattern.
LINGUISTICS_REVIEW = (
    ("school-like", r"(?:الصف(?:\s|$)|المرحلة\s*(?:الابتدائية|الإعدادية|الاعدادية|الثانوية)|ابتدائي|ابتدائية|إعدادي|اعدادي|ثانوي|امتحان|اختبار|مذكرة|ملزمة|كراسة|ورقة\s*عمل|دليل\s*المعلم|دليل\s*الطالب|تلاميذ|التلميذ|مدرسة|مدارس|كتاب\s*(?:الطالب|التلميذ))"),
    ("noisy", r"(?:^\s*[_○♣♦•·\d\-]+|اقرا\s*اونلاين|اقرأ\s*اونلاين|\bpdf\b|\bhtm\b|\bhtml\b|\bwww\b|upscaled|صيغة\s*(?:ويب|وورد|word)|\bكتاب\s+اقرا)"),
    ("pedagogic", r"(?:تعليم|تدريس|طرائق\s*تدريس|مناهج\s*اللغة|تعلم\s*اللغة)"),
)
DICTIONARY_REVIEW = (
    ("suspicious", r"(?:شيوخ|رجال|صحابة|رواة|بلدان|أنساب|قبائل|فتاوى|فقه|فقهاء|قراءات|مؤلفين|مخطوطات|طرق صوفية|أعلام|سير|تراجم|دول|تاريخ|سياسة|طب|هندسة|اقتصاد|قانون|رياضيات)"),
    ("school-like", r"(?:مراجعة|اختبار|امتحان|تمارين|ورقة عمل|الصف|الثانوي|الابتدائي|واجبات)"),
    ("malformed", r"(?:^\d{3,}|\bpdf\b|\bbook\b|_)"),
)
