"""The extraction programs as parameter sets. Patterns, limits and questions are fixed values."""

from __future__ import annotations

from ..operators.excerpts import ExcerptSpec

IBD_TYPE = (
    r"(?i)crohn|ulcerative\s+colitis|"
    r"(for|of|vs\.|vs|with|hx|dx|c\/w|mild|active|severe|moderate|chronic)\s+(\buc\b|\bu\.c\.\b)|"
    r"\bcuc\b|\bc\.u\.c\.\b|inflammatory\s+bowel\s+disease|"
    r"\bibd\b|ulcerative\s+proct|chronic\s+colitis|chronic\s+proct|"
    r"colonosc.*\bfindings"
)
COLECTOMY = (
    r"(?i)colectomy|proctectomy|"
    r"(remov|resect).{0,20}?(colo|rect|cecum|sigmoid)|"
    r"(colo|rect|cecum|sigmoid).{0,20}?(remov|resect)|"
    r"hartmann"
)
COLONOSCOPY = r"(?i)((recent|last|had|\d+)\s+colonoscopy)|(colonoscopy\s+(last|done|at|was|in|on|\d+|performed|report))"
CRC = r"(?i)((colon|colorectal|rectal)\s+(adenocarcinoma|carcinoma|cancer))|crc"
CRC_IGNORE = r"(?i)(surveillance|screen|detection|prevent|family\s+(history|hx))"
_DISEASE = (
    r"(crohn|ulcerative\s+colitis|\buc\b|\bu\.c\.\b|\bcuc\b|\bc\.u\.c\.\b|"
    r"inflammatory\s+bowel\s+disease|\bibd\b|ulcerative\s+proct|chronic\s+colitis|chronic\s+proct)"
)
_NUMBER, _YEAR = r"((\b\d{2}\b)|(\b\d{4}\b))", r"((19|20)\d{2})"
IBD_YEAR = rf"(?i)({_DISEASE}.{{0,30}}?{_NUMBER})|({_NUMBER}.{{0,30}}?{_DISEASE})"
IBD_YEAR_PRIORITY = rf"(?i)({_DISEASE}.{{0,30}}?{_YEAR})|({_YEAR}.{{0,30}}?{_DISEASE})"
ICD_IGNORE = r"(?i)(556|555|K52|K51|K50|ICD|snomed)"

Q_COLECTOMY = "\nQuestion: Has this patient had all or part of their colon or rectum removed?\n"
Q_CRC = "\nQuestion: Has this patient been diagnosed with colorectal cancer (CRC)? If so, what was the year and month of CRC diagnosis?\n"
Q_YEAR = "\nQuestion: When was this patient originally diagnosed with IBD (Ulcerative colitis or Crohn's disease)?\n"

PROGRAMS: dict[str, ExcerptSpec] = {
    "ibd_type": ExcerptSpec(IBD_TYPE, 3, 3, 15, 5, before_few=30, few_notes=5, day_format="yyyy-MM-dd", label="YYYY-MM-DD", dedup=False),
    "colectomy": ExcerptSpec(COLECTOMY, 2, 2, 20, 5, 5, question=Q_COLECTOMY),
    "colonoscopy": ExcerptSpec(COLONOSCOPY, 2, 2, 20, 0, day_format="yyyy", label="YYYY", chunk=True),
    "crc_free_text": ExcerptSpec(CRC, 5, 5, 50, 15, 10, 10, exclude=CRC_IGNORE, question=Q_CRC),
    "either_positive": ExcerptSpec(CRC, 20, 15, 40, 10, 5, 10, question=Q_CRC),
    "either_positive_short": ExcerptSpec(CRC, 15, 10, 30, 5, 3, 10, question=Q_CRC),
    "ibd_year": ExcerptSpec(IBD_YEAR, 2, 2, 30, 3, 15, 10, exclude=ICD_IGNORE, priority=IBD_YEAR_PRIORITY, question=Q_YEAR, keep_empty=True),
}
