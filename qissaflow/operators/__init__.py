"""Feature profiles, rules, analyses, segmentation, models, scores and explanations, morphology and annotations."""
