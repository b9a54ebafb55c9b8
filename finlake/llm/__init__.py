"""Operations of a training-data pipeline over ``documents``: near-duplicates, mixing, private data,
tokenisation, quality, language, fingerprints, licenses and secrets. Nothing outside this package
imports it."""
