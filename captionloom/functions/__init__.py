"""Part of captionloom; see the README for what each module holds."""
