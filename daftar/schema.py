"""The one row type of the catalog, and the types of its sources."""

from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

_S, _A = StringType(), ArrayType(StringType())
EVIDENCE = StructType([StructField("strongSignals", _A), StructField("supportingSignals", _A), StructField("explicitLanguageSource", BooleanType())])
#: A record as it is stored; the catalog adds its place (ord) and its batch.
RECORD = StructType([
    StructField("id", _S), StructField("title", _S), StructField("author", _S), StructField("source", _S), StructField("relativePath", _S), StructField("sourceUrl", _S),
    StructField("primaryCategory", _S), StructField("tags", _A), StructField("matchEvidence", EVIDENCE),
])
MATERIAL = StructType([*RECORD.fields, StructField("batch_rank", IntegerType()), StructField("ord", LongType())])
REFERENCE = StructType([StructField("source", _S), StructField("url", _S)])
DIWAN = StructType([*RECORD.fields, StructField("volumes", IntegerType()), StructField("pages", IntegerType()), StructField("sourceRefs", ArrayType(REFERENCE)), StructField("sourceCount", IntegerType())])
ACADEMY = StructType([StructField(c, _S) for c in ("id", "title", "academy", "country", "materialType", "year", "linkStatus", "url", "description", "sourceFile")])
CLUB = StructType([StructField(c, _S) for c in ("id", "title", "club", "city", "country", "materialType", "year", "linkStatus", "url", "description", "sourceFile")])
#: Curriculum columns keep their Arabic names in the source; these are the engine's.
CURRICULUM_NAMES = {
    "الرقم": "number", "العنوان": "title", "النوع": "type", "الجهة": "organization", "الدولة": "country", "المرحلة": "stage",
    "الفئة المستهدفة": "audience", "حالة التحقق": "verification", "الرابط": "url", "التصنيفات": "labels",
}
CURRICULUM = StructType([StructField(c, LongType() if c == "الرقم" else _A if c == "التصنيفات" else _S) for c in CURRICULUM_NAMES])
#: An archive document after its polymorphic fields became arrays.
ARCHIVE_FIELDS = ("identifier", "title", "creator", "year", "date", "publicdate", "language", "subject", "description", "collection", "mediatype")
CATEGORIES = ("academic_theses", "references", "dictionaries", "bilingual_dictionaries", "diwans", "scientific_poems", "curricula", "academies", "literary_clubs")
UNSPECIFIED = "غير محدد"
ARCHIVE_SOURCE = "Internet Archive"
