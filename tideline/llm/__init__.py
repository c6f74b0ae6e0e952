"""Training-data operators: secrets, language, decontamination, quality, media, near duplicates, token files, sentence pieces,
repeated passages and licences. Nothing else in the library imports this subpackage."""
