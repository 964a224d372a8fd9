"""J: streaming jobs and their batch twins."""
