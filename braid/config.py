"""What a fusion run depends on beside its data. All tables are small literals that plans embed."""
from __future__ import annotations

from dataclasses import dataclass, field

# Sources by priority, confidences, weights, spellings. Results depend on each of them.
PRIORITY = ("csv", "resume", "linkedin", "github")

FIELD_CONFIDENCE = {
    "csv": {"full_name": 0.95, "emails": 0.98, "phones": 0.95, "current_company": 0.90, "current_title": 0.90, "name": 0.95, "email": 0.98, "phone": 0.95},
    "resume": {"full_name": 0.85, "emails": 0.92, "phones": 0.88, "skills": 0.82, "education": 0.85, "experience": 0.85, "headline": 0.80, "location": 0.75, "name": 0.85, "email": 0.92, "phone": 0.88},
    "linkedin": {"headline": 0.88, "location": 0.80, "skills": 0.78, "experience": 0.80, "education": 0.80, "links": 0.72},
    "github": {"full_name": 0.70, "bio": 0.65, "location": 0.60, "links": 0.80, "github_languages": 0.90, "github_repos": 0.90, "name": 0.70, "website": 0.80},
}
SOURCE_CONFIDENCE = {"csv": 0.88, "resume": 0.78, "linkedin": 0.72, "github": 0.65}
OTHER_CONFIDENCE = 0.60

FIELD_WEIGHTS = {"emails": 2.0, "full_name": 1.5, "phones": 1.0, "headline": 1.0, "skills": 0.8, "experience": 0.8, "education": 0.8, "location": 0.5, "links": 0.4, "years_experience": 0.5, "current_company": 0.7, "current_title": 0.7, "email": 2.0, "name": 1.5, "phone": 1.0}
OTHER_WEIGHT = 0.5

COUNTRIES = {
    "US": ("united states", "usa", "us", "america"),
    "GB": ("united kingdom", "uk", "britain"),
    "IN": ("india",),
    "CA": ("canada",),
    "AU": ("australia",),
    "DE": ("germany",),
    "FR": ("france",),
    "SG": ("singapore",),
    "NL": ("netherlands",),
}

SKILLS = {
    "C++": ("c++", "c plus plus", "c++ programming", "cplusplus"),
    "C#": ("c#", "csharp", "c sharp"),
    "JavaScript": ("javascript", "js", "java script"),
    "TypeScript": ("typescript", "ts"),
    "Python": ("python", "python3", "python 3"),
    "Machine Learning": ("machine learning", "ml", "machinelearning"),
    "Deep Learning": ("deep learning", "dl", "deeplearning"),
    "Natural Language Processing": ("nlp", "natural language processing"),
    "SQL": ("sql", "structured query language"),
    "React": ("react", "reactjs", "react.js"),
    "Node.js": ("node.js", "nodejs", "node js"),
    "Docker": ("docker", "docker container"),
    "Kubernetes": ("kubernetes", "k8s"),
    "AWS": ("aws", "amazon web services"),
    "GCP": ("gcp", "google cloud", "google cloud platform"),
    "Azure": ("azure", "microsoft azure"),
    "Git": ("git", "git version control"),
    "Java": ("java",),
    "Go": ("golang", "go language"),
    "Rust": ("rust", "rust lang"),
    "Ruby": ("ruby", "ruby on rails"),
    "TensorFlow": ("tensorflow", "tf"),
    "PyTorch": ("pytorch", "torch"),
    "Pandas": ("pandas",),
    "NumPy": ("numpy",),
    "REST API": ("rest", "rest api", "restful", "restful api"),
    "GraphQL": ("graphql",),
    "PostgreSQL": ("postgresql", "postgres"),
    "MongoDB": ("mongodb", "mongo"),
    "Redis": ("redis",),
}

#: National numbers by country code, as the public numbering plans give their lengths and first digits. An
#: approximation: it can't tell unassigned area codes. Codes that aren't here have no valid numbers.
PHONES = {
    "1": "[2-9][0-9]{2}[2-9][0-9]{6}",
    "7": "[34789][0-9]{9}",
    "20": "[1-9][0-9]{7,9}",
    "27": "[1-8][0-9]{8}",
    "30": "[26][0-9]{9}",
    "31": "[1-9][0-9]{8}",
    "32": "[1-9][0-9]{7,8}",
    "33": "[1-9][0-9]{8}",
    "34": "[6-9][0-9]{8}",
    "36": "[1-9][0-9]{7,8}",
    "39": "(?:0[0-9]{5,10}|3[0-9]{8,9})",
    "40": "[2-9][0-9]{8}",
    "41": "[2-9][0-9]{8}",
    "43": "[1-9][0-9]{6,11}",
    "44": "[1-35789][0-9]{8,9}",
    "45": "[2-9][0-9]{7}",
    "46": "[1-9][0-9]{6,9}",
    "47": "[2-9][0-9]{7}",
    "48": "[1-9][0-9]{8}",
    "49": "[1-9][0-9]{6,11}",
    "51": "[1-9][0-9]{7,8}",
    "52": "[2-9][0-9]{9}",
    "54": "9?[1-9][0-9]{9}",
    "55": "[1-9][1-9](?:9[0-9]{8}|[2-5][0-9]{7})",
    "56": "[2-9][0-9]{8}",
    "57": "[1-9][0-9]{9}",
    "60": "[1-9][0-9]{7,9}",
    "61": "[2-478][0-9]{8}",
    "62": "[1-9][0-9]{6,11}",
    "63": "[2-9][0-9]{7,9}",
    "64": "[2-9][0-9]{7,9}",
    "65": "[3689][0-9]{7}",
    "66": "[2-9][0-9]{7,8}",
    "81": "[1-9][0-9]{8,9}",
    "82": "[1-9][0-9]{7,9}",
    "84": "[2-9][0-9]{8,9}",
    "86": "(?:1[3-9][0-9]{9}|[2-9][0-9]{8,10}|10[0-9]{8})",
    "90": "[2-5][0-9]{9}",
    "91": "[6-9][0-9]{9}",
    "92": "[2-9][0-9]{8,9}",
    "94": "[1-9][0-9]{8}",
    "98": "[1-9][0-9]{9}",
    "212": "[5-8][0-9]{8}",
    "213": "[2-7][0-9]{7,8}",
    "216": "[2-9][0-9]{7}",
    "233": "[2-5][0-9]{8}",
    "234": "[1-9][0-9]{6,9}",
    "251": "[1-9][0-9]{8}",
    "254": "[1-9][0-9]{8}",
    "255": "[2-7][0-9]{8}",
    "256": "[2-7][0-9]{8}",
    "351": "[29][0-9]{8}",
    "352": "[2-9][0-9]{5,8}",
    "353": "[1-9][0-9]{7,8}",
    "354": "[4-8][0-9]{6}",
    "358": "[1-9][0-9]{6,9}",
    "359": "[2-9][0-9]{7,8}",
    "370": "[3-8][0-9]{7}",
    "371": "[2-8][0-9]{7}",
    "372": "[3-8][0-9]{6,7}",
    "380": "[3-9][0-9]{8}",
    "381": "[1-9][0-9]{7,8}",
    "385": "[1-9][0-9]{7,8}",
    "386": "[1-7][0-9]{7}",
    "420": "[2-9][0-9]{8}",
    "421": "[2-9][0-9]{8}",
    "852": "[2-9][0-9]{7}",
    "880": "[1-9][0-9]{8,9}",
    "886": "[2-9][0-9]{7,8}",
    "962": "[2-7][0-9]{7,8}",
    "965": "[2-9][0-9]{7}",
    "966": "[1-9][0-9]{8}",
    "971": "(?:5[0-9]{8}|[2-9][0-9]{7})",
    "972": "[2-9][0-9]{7,8}",
    "974": "[3-7][0-9]{7}",
    "977": "[1-9][0-9]{7,9}",
}
#: Country codes, and international prefixes dialled there, of the regions that numbers without + may be from.
REGIONS = {"US": ("1", "011"), "CA": ("1", "011"), "GB": ("44", "00"), "IN": ("91", "00"), "DE": ("49", "00"), "FR": ("33", "00"), "NL": ("31", "00"), "SG": ("65", "00"), "AU": ("61", "0011")}


def aliases(table: dict[str, tuple[str, ...]]) -> dict[str, str]:
    """Each canonical name's own spelling and its aliases, in lower case, to the name."""
    return {a.lower(): name for name, others in table.items() for a in (name, *others)}


@dataclass(frozen=True)
class FusionConfig:
    """Change any table to extend the engine: a new source needs a priority and its confidences only."""

    priority: tuple[str, ...] = PRIORITY
    field_confidence: dict = field(default_factory=lambda: FIELD_CONFIDENCE)
    source_confidence: dict = field(default_factory=lambda: SOURCE_CONFIDENCE)
    weights: dict = field(default_factory=lambda: FIELD_WEIGHTS)
    skills: dict = field(default_factory=lambda: SKILLS)
    phones: dict = field(default_factory=lambda: PHONES)
    region: str = "US"
    name_threshold: float = 85.0
    low_confidence: float = 0.4
    #: Parts of places lose spaces at their ends and no other white space, as SQL's trim does it.
    places_trim_spaces_only: bool = False
    #: The year that open-ended experience reaches to; None is the current one.
    as_of: int | None = None

    def confidence(self, source: str, name: str) -> float:
        return self.field_confidence.get(source, {}).get(name, self.source_confidence.get(source, OTHER_CONFIDENCE))

    def rank(self, source: str) -> int:
        return self.priority.index(source) if source in self.priority else 99
