"""Files, images and PDFs as rows."""
