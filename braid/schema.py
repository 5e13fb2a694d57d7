"""Row types."""
LOCATION = "struct<city:string,region:string,country:string>"
LINKS = "struct<linkedin:string,github:string,website:string>"
EXPERIENCE = "array<struct<title:string,company:string,start_date:string,end_date:string,description:string,source:string>>"
EDUCATION = "array<struct<school:string,degree:string,field_of_study:string,start_date:string,end_date:string,source:string>>"
#: One row per (candidate, source). Sources may leave columns out; aligned() adds them as null.
SOURCE_PROFILE = {
    "candidate_key": "string",
    "source": "string",
    "seq": "int",
    "full_name": "string",
    "name": "string",
    "emails": "array<string>",
    "email": "string",
    "phones": "array<string>",
    "phone": "string",
    "location_raw": "string",
    "headline": "string",
    "bio": "string",
    "current_company": "string",
    "current_title": "string",
    "profile_url": "string",
    "website": "string",
    "skills": "array<string>",
    "experience": EXPERIENCE,
    "education": EDUCATION,
    "github_repos": "array<string>",
    "github_languages": "array<string>",
}


def aligned(df, source: str, seq: int = 0):
    """df with exactly the columns of SOURCE_PROFILE, cast."""
    from pyspark.sql import functions as F

    have = {"source": F.lit(source), "seq": F.lit(seq)}
    return df.select(*[(have.get(c) if c in have and c not in df.columns else df[c] if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in SOURCE_PROFILE.items()])
