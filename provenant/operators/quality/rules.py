"""What the repairs know: canonical spellings, regions, words for yes and no, thresholds."""

# The results of country and region repair must agree with these tables.
CANONICAL_COUNTRY = {
    "usa": "USA", "us": "USA", "u.s.a.": "USA", "u.s.": "USA", "united states": "USA", "united states of america": "USA",
    "uk": "UK", "u.k.": "UK", "united kingdom": "UK", "great britain": "UK", "england": "UK",
    "germany": "Germany", "deutschland": "Germany", "france": "France", "india": "India", "bharat": "India",
    "singapore": "Singapore", "australia": "Australia", "canada": "Canada",
}
COUNTRY_REGION = {
    "usa": "AMER", "united states": "AMER", "us": "AMER", "canada": "AMER", "mexico": "AMER",
    "uk": "EMEA", "united kingdom": "EMEA", "france": "EMEA", "germany": "EMEA", "spain": "EMEA", "italy": "EMEA",
    "india": "APAC", "singapore": "APAC", "australia": "APAC", "japan": "APAC", "china": "APAC",
    "brazil": "LATAM", "argentina": "LATAM",
}
TRUE_WORDS, FALSE_WORDS = ("true", "t", "yes", "y", "1"), ("false", "f", "no", "n", "0")

AUTO_APPLY = 0.95
PARSE_RATE = 0.99
STRUCTURAL_NULLS = 0.90
MISMATCH_HIGH = 0.05
DUPLICATES_HIGH = 0.01
