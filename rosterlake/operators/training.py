"""Certificates that are courses, told by words in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Patterns of courses, of their providers, and words of their subjects.
COURSE = [
    r"διάρκει(?:ας|α)", r"\d+\s*ωρ(?:ών|ες)", r"σεμιν[αά]ρι", r"workshop", r"βέλτιστ(?:ες|ων)\s*πρακτικ", r"αλλαγ(?:ές|ών)\s*στ(?:ην|ις|ον|ο)",
    r"πρόσφατ(?:ες|ων)\s*αλλαγ", r"εκπαιδευτικ(?:ό|ά)\s*πρόγραμμα", r"επιμόρφωσ[ηι]",
]
PROVIDER = ["επιμελητήριο", "οικονομικό επιμελητήριο", "εργαστήριο", "ινστιτούτο.*διοίκησης", "κέντρο.*εκπαίδευσης", "τμήμα.*εκπαίδευσης"]
SUBJECT = {
    "legal": ["νομοθεσία", "νομικ", "νόμ.", "ν."], "accounting": ["λογιστ", "κοστολόγ", "φορολογ", "οικονομικ"],
    "hr": ["ανθρώπινου δυναμικού", "hr", "διοίκηση προσωπικού"], "it": ["πληροφορικ", "it", "software"],
    "safety": ["ασφάλεια", "safety"], "management": ["διοίκηση", "management"],
}
HEADING = r"(?imu)^\h*σεμιν[αά]ρια\h*$"


def split_courses(certificates: DataFrame, name: str, issuer: str, raw: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(certificates that stay, courses).

    A course has a course pattern in name or issuer, a provider as issuer, or one of the
    first three words of its name (of over three letters) under the heading of seminars
    in raw, the person's whole text.  Courses gain subject, hours, provider_type.
    """
    title, by = F.lower(F.coalesce(F.col(name), F.lit(""))), F.lower(F.coalesce(F.col(issuer), F.lit("")))
    both = F.concat_ws(" ", title, by)
    course = both.rlike("|".join(COURSE)) | by.rlike("|".join(PROVIDER))
    if raw:
        after = F.lower(F.get(F.split(F.col(raw), HEADING, 2), F.lit(1)))
        section = F.get(F.split(after, r"(?m)^\h*[α-ωά-ώ]+\h*$", 2), F.lit(0))
        words = F.filter(F.slice(F.split(title, r"\s+"), 1, 3), lambda w: F.length(w) > 3)
        course = course | F.coalesce(F.exists(words, lambda w: F.contains(section, w)), F.lit(False))
    subject = F.lit(None).cast("string")
    for label, parts in reversed(SUBJECT.items()):
        held = F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(title, p))
        subject = F.when(held, label).otherwise(subject)
    hours = F.regexp_extract(both, r"(\d+)\s*ωρ(?:ών|ες)", 1).try_cast("int")
    kind = F.when(by.contains("επιμελητήριο"), "professional_body").otherwise("other")
    courses = certificates.where(course).withColumns({"subject": subject, "hours": hours, "provider_type": kind})
    return certificates.where(~course), courses
