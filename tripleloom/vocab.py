"""Fixed vocabulary IRIs (W3C RDF, XSD, R2RML and the RML extension)."""

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"
RR = "http://www.w3.org/ns/r2rml#"
RML = "http://semweb.mmlab.be/ns/rml#"
QL = "http://semweb.mmlab.be/ns/ql#"
STREAM = "http://carml.taxonic.com/carml/Stream"
FNML = "http://semweb.mmlab.be/ns/fnml#"
EXECUTES = "https://w3id.org/function/ontology#executes"

RDF_TYPE = RDF + "type"
XSD_STRING = XSD + "string"

INPUT_FORMATS = ("JSON", "CSV", "XML")
OUTPUT_FORMATS = ("TTL", "JSONLD")
BROKER_TYPES = ("MQTT", "KAFKA")
