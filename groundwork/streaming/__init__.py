"""The same decisions on streams: conversations as they come, tokens of a model's output."""
