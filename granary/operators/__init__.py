"""Quality metrics as DataFrame plans: completeness, duplicates, outliers, timeliness, recommendations."""
