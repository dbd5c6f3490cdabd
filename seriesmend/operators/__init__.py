"""Selection, correction, detection, annotation and view operators."""
